import itertools
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import versions as V
from docloom.operators import build, catalog, corpus, crawl, publish, releases
from docloom.operators.sections import sections, skipped_files
from docloom.sources import definitions, packages
from docloom.sources import files as sources

ORDER = ["canary", "edge", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0", "1.0.0", "1.15.9", "1.15.10", "v2", "10.0"]


def test_full_version_order(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ORDER)], "i int, v string")
    for parts in (1, 3):
        got = [r.v for r in df.repartition(parts).orderBy(V.version_key(F.col("v"))).collect()]
        assert got == ORDER


def test_any_number_and_length_of_segments(spark):
    pairs = [("1.2.3.4.5.6.7", "1.2.3.4.5.6.8", -1), ("1.0.0.0.0.0.0.1", "1", 1), ("1.2", "1.2.0.0", 0), ("1.9", "1.10", -1), ("123456789012345678901234567890", "123456789012345678901234567891", -1), ("1.2.rc1", "1.3.0", -1), ("1.2.rc1", "1.2.0", None), ("", "1", -1), (None, "1", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = df.select(V.dotted_compare(F.col("a"), F.col("b")).alias("c"), V.dotted_below(F.col("a"), F.col("b")).alias("lt"), V.dotted_reaches(F.col("a"), F.col("b")).alias("ge")).collect()
    assert [r.c for r in got] == [c for *_, c in pairs]
    assert [(r["lt"], r["ge"]) for r in got] == [(c == -1, c in (0, 1)) for *_, c in pairs]
    long = ["1.2.3.4.5.6.7", "1.2.3.4.5.6.8", "1.2.3.4.5.6.10", "2"]
    df = spark.createDataFrame([(v,) for v in reversed(long)], "version string")
    assert [r.version for r in df.orderBy(V.version_key(F.col("version"))).collect()] == long
    assert sorted((r.place, r.version) for r in releases.placed(spark.createDataFrame([(v,) for v in ORDER], "version string")).collect()) == list(enumerate(ORDER, 1))


def test_prereleases_and_ranges(spark):
    df = spark.createDataFrame([(v,) for v in ["1.2.3", "v1.2.3", "4.0a1", "3.0.0.RELEASE", "1.0.0-b", "1.0+x", "1.2"]], "v string")
    assert [r.p for r in df.select(V.is_prerelease(F.col("v")).alias("p")).collect()] == [False, True, True, True, True, True, False]
    rel = spark.createDataFrame([("npm", "a", v, None, i) for i, v in enumerate(["1.0.0", "1.0.1", "1.1.0", "2.0.0", "2.1.0", "0.9.0"])], "registry string, name string, version string, published_at date, ord int")
    ent = spark.createDataFrame([("npm", "a", 0, "2.0.0", None, None), ("npm", "a", 1, "1.0.0", "2.0.0", None), ("npm", "a", 2, "1.5.0", None, None)], "registry string, name string, entry_ord int, min_version string, max_version string, versions array<string>")
    got = releases.resolve_entries(rel, ent)
    assert {r.version: r.entry_ord for r in got.collect()} == {"1.0.0": 1, "1.0.1": 1, "1.1.0": 1, "2.0.0": 0, "2.1.0": 0}
    defs = spark.createDataFrame([("npm", "a", "versioned", True), ("npm", "u", "unversioned", True), ("x", "n", "versioned", False)], "registry string, name string, kind string, has_feed boolean")
    found = releases.discover(rel, ent, defs, 7, F.lit("2024-01-01").cast("date"), 10).collect()
    assert sorted((r.name, r.version or "", r.kind) for r in found) == [("a", "1.0.1", "release"), ("a", "1.1.0", "release"), ("a", "2.0.0", "release"), ("a", "2.1.0", "release"), ("n", "", "unsupported"), ("u", "latest", "latest")]


def test_tags(spark):
    tags = spark.createDataFrame([("r", t, i) for i, t in enumerate(["v1.0.0", "v1.2.0", "v2.0.0-rc.1", "@ai-sdk/svelte@4.0.1", "ai@5.0.0", "AI@5.1.0", "ai@6.0.0-beta.1"])], "repo string, tag string, ord int")
    want = spark.createDataFrame([("r", "ai"), ("r", "@ai-sdk/svelte"), ("r", "zod"), ("none", "x")], "repo string, package string")
    assert {r.package: r.tag for r in releases.latest_stable_tags(want, tags).collect()} == {"ai": "AI@5.1.0", "@ai-sdk/svelte": "@ai-sdk/svelte@4.0.1", "zod": "v1.2.0", "x": None}


def test_tag_parts(spark):
    want = {"1.2.3": (None, "1.2.3"), "v1.2.3": (None, "1.2.3"), "ai@6.0.68": ("ai", "6.0.68"), "@ai-sdk/gateway@2.0.31": ("@ai-sdk/gateway", "2.0.31"), "ai@6.0.68-canary.0": ("ai", "6.0.68-canary.0"), "a@1@2": ("a", "1@2"), "@s/p@v1@2": ("@s/p", "v1@2")}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: (r.package, r.version) for r in df.select("t", V.tag_parts(F.col("t")).alias("p")).select("t", "p.*").collect()} == want


def test_catalog(spark):
    cat = spark.createDataFrame([("next", "15.0.0"), ("next", "16.0.0"), ("next", "16.0.0-canary.1"), ("@s/react", "1.0")], "name string, version string")
    specs = spark.createDataFrame([("next",), ("next@15.0.0",), ("@s/react",), ("nope",), ("next@14",)], "spec string")
    assert {r.spec: r.version for r in catalog.resolve(specs, cat).collect()} == {"next": "16.0.0", "next@15.0.0": "15.0.0", "@s/react": "1.0", "nope": None, "next@14": None}
    assert {r.spec: (r.status, r.target) for r in catalog.removals(specs, cat).collect()} == {"next": ("ambiguous", None), "next@15.0.0": ("remove", "next@15.0.0"), "@s/react": ("remove", "@s/react@1.0"), "nope": ("missing", None), "next@14": ("missing", None)}
    assert {r.spec: r.status for r in catalog.allowed_problems(specs, cat).collect()} == {"next": "ok", "next@15.0.0": "ok", "@s/react": "ok", "nope": "not installed", "next@14": "wrong version"}


def test_listing(spark):
    cat = spark.createDataFrame([("b", "1.0"), ("a", "1.9"), ("a", "1.10"), ("ab", "latest"), ("b", "2.0-rc.1")], "name string, version string")
    assert [(r.name, r.version) for r in catalog.listing(cat).orderBy("place").collect()] == [("a", "1.10"), ("a", "1.9"), ("ab", "latest"), ("b", "2.0-rc.1"), ("b", "1.0")]


@pytest.mark.parametrize(("pattern", "path", "fits"), [("a[bc]d", "abd", True), ("a[!bc]d", "abd", False), ("a[!bc]d", "x/axd", True), ("\\!keep", "!keep", True), ("\\#x", "#x", True), ("a\\*b", "a*b", True), ("a\\*b", "axb", False), ("docs/**", "docs/a/b", True), ("docs/**", "docs/", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("BUILD/", "build/", True), ("build/", "build", False), ("/top", "top", True), ("/top", "x/top", False), ("a[b", "a[b", True), ("x ", "x", True), ("[a-c].md", "d/b.md", True), ("[^/]x", "/x", False)])
def test_ignore_patterns(pattern, path, fits):
    import re

    assert bool(re.search(corpus.ignore_regex(pattern), path)) == fits


def test_files_without_content_are_no_copies(spark):
    files = spark.createDataFrame([("p", 1, None), ("p", 2, None), ("p", 3, "x"), ("p", 4, "x")], "package_id string, file_ord long, content string")
    assert sorted(r.file_ord for r in corpus.unique_files(files).collect()) == [1, 2, 3]


def test_ignore_rules(spark):
    files = spark.createDataFrame([("p", "a.md"), ("p", "build/x.md"), ("p", "src/build/y.md"), ("p", "keep/z.log"), ("p", "z.log"), ("q", "build/x.md")], "package_id string, path string")
    rules = spark.createDataFrame([("p", 0, "build/"), ("p", 1, "*.log"), ("p", 2, "!keep/*.log"), ("p", 3, "# c")], "package_id string, ord int, pattern string")
    assert sorted((r.package_id, r.path) for r in corpus.drop_ignored(files, rules).collect()) == [("p", "a.md"), ("p", "keep/z.log"), ("q", "build/x.md")]


def test_ignore_rules_against_a_plain_loop(spark):
    """Random rules and trees: prefixes of a path are judged one after another, each by all rules."""
    import random
    import re

    rng = random.Random(3)
    names = ["a", "B", "docs", "x.md", "y.log", "build"]
    path = lambda n: "/".join(rng.choice(names) for _ in range(rng.randint(1, n)))
    forms = ["*.md", "docs/", "!docs/", "/a", "!a/x.md", "a/**", "**/build", "!*.log", "y.log", "b", "!B/", "# a", " ", "!x.*", "[ab]", "docs/**/x.md"]
    rules = [(p, k, rng.choice(forms)) for p in "pqrs" for k in range(rng.randint(1, 9))]
    files = [(p, k, path(6)) for p in ["p", "q", "r", "s", "none", None] for k in range(300)]

    def ignored(package, path):
        own = [(t.startswith("!"), re.compile(corpus.ignore_regex(t.removeprefix("!")))) for p, _, t in rules if p == package and t.strip() and t[0] != "#"]
        parts = path.split("/")
        for i in range(1, len(parts) + 1):
            prefix, verdict = "/".join(parts[:i]) + ("/" if i < len(parts) else ""), False
            for keep, rx in own:
                verdict = not keep if rx.search(prefix) else verdict
            if verdict:
                return True
        return False

    df = spark.createDataFrame(files, "package_id string, file_ord int, path string")
    got = corpus.drop_ignored(df, spark.createDataFrame(rules, "package_id string, ord int, pattern string"))
    assert got.columns == df.columns
    key = lambda r: (r[0] or "", r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((f for f in files if not ignored(f[0], f[2])), key=key)
    assert corpus.drop_ignored(df, spark.createDataFrame([], "package_id string, ord int, pattern string")).count() == len(files)
    assert corpus.drop_ignored(df.limit(0), spark.createDataFrame(rules, "package_id string, ord int, pattern string")).count() == 0


def test_a_package_of_many_rules(spark):
    rules = spark.createDataFrame([("p", k, f"!d{k}/keep*.md" if k % 3 == 0 else f"d{k}/*.md") for k in range(900)], "package_id string, ord int, pattern string")
    files = spark.createDataFrame([("p", f"d{k}/x.md") for k in range(900)], "package_id string, path string")
    assert corpus.drop_ignored(files, rules).count() == 300


@pytest.mark.parametrize(("glob", "path", "fits"), [("a/*", "a/b", True), ("a/*", "a/b/c", False), ("a/**", "a/b/c", True), ("*.md", "x.md", True), ("*.md", "d/x.md", False), ("a.b", "axb", False)])
def test_globs(glob, path, fits):
    import re

    assert bool(re.search(corpus.glob_regex(glob), path)) == fits


def test_copies_and_broken_files(spark):
    shared = "## Shared\nThis text is the same in all of them, word for word."
    files = spark.createDataFrame([("p", i, f"{i}.md", shared + f"\n\n## Overview\nOverview number {i} of the files.") for i in range(3)] + [("p", 9, "x.md", None)], "package_id string, file_ord long, path string, content string")
    parsed = sections(files)
    kept = build.numbered(build.unique_sections(parsed.filter("error is null"))).collect()
    assert sorted((r.id, r.file_ord, r.section_title) for r in kept) == [(1, 0, "Shared"), (2, 0, "Overview"), (3, 1, "Overview"), (4, 2, "Overview")]
    assert skipped_files(parsed).first().skipped_files == 1


def test_links(spark):
    text = "# T\n## Docs\n- [A](https://x.org/a): first\n- [B](/b \"its title\")\nsee [no](https://x.org/no)\n## More\n*[A2](https://x.org/a)\n- [C](http://[bad)\n- [D](https://y.org/d)"
    docs = spark.createDataFrame([(1, "https://x.org/llms.txt", text)], "doc_id int, base_url string, content string")
    found = crawl.resolved(crawl.index_links(docs).join(docs.select("doc_id", "base_url"), "doc_id"))
    assert [(r.section, r.title, r.url) for r in found.orderBy("line_no").collect()] == [("Docs", "A", "https://x.org/a"), ("Docs", "B", "https://x.org/b"), ("More", "A2", "https://x.org/a"), ("More", "D", "https://y.org/d")]
    same = crawl.same_host_links(found)
    assert [r.url for r in same.orderBy("rank").collect()] == ["https://x.org/a", "https://x.org/b"]
    assert crawl.same_host_links(found, 1).count() == 1


def test_errors(spark):
    transient = ["fatal: unable to access 'https://x/': Failed to connect to x port 443 after 135337 ms", "Could not resolve host: x", "error: The requested URL returned error: 503", "RPC failed; curl 56", "GnuTLS recv error (-110)", "Connection timed out", "fatal: early EOF"]
    missing = ["Git clone failed: Cloning into '/x'...\nfatal: Remote branch v4.1.9 not found in upstream origin", "error: pathspec 'v4.1.9' did not match any file(s)", "Could not find remote branch x", "reference 'y' did not match"]
    other = ["remote: Repository not found.", "fatal: Authentication failed for 'https://...'", "no sections", "returned error: 404"]
    df = spark.createDataFrame([(m,) for m in transient + missing + other], "m string")
    got = {r.m: r.c for r in df.select("m", publish.error_class(F.col("m")).alias("c")).collect()}
    assert got == dict.fromkeys(transient, "transient") | dict.fromkeys(missing, "missing ref") | dict.fromkeys(other, "other")


def one_column(spark, values, column):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: r.out for r in df.select("v", column(F.col("v")).alias("out")).collect()}


def test_kinds_of_sources(spark):
    want = {
        "git": ["https://github.com/vercel/next.js", "https://github.com/facebook/react/tree/main", "https://gitlab.com/org/repo", "https://bitbucket.org/org/repo", "git@github.com:user/repo.git", "ssh://git@github.com/user/repo.git", "https://x.org/a.git"],
        "url": ["http://example.com/package.db", "https://github.com/user/repo/releases/download/v1/package.db"],
        "website": ["https://react-aria.adobe.com", "https://mui.com/material-ui/llms-full.txt", "https://github.com/o/r/releases/tag/v1", "https://github.com/o/r/blob/main/README.md"],
        "file": ["./package.db", "C:\\Users\\package.db", "vercel/next.js", "", "   ", "folder/repo.git"],
    }
    assert one_column(spark, [v for vs in want.values() for v in vs], crawl.source_kind) == {v: k for k, vs in want.items() for v in vs}


def test_repositories(spark):
    names = {"https://github.com/owner/owner.github.io": "owner", "https://github.com/expressjs/expressjs.com": "express", "https://github.com/org/project-docs": "project", "https://github.com/expressjs/express.js": "express", "git@github.com:user/My_Repo.git": "my-repo", "https://github.com/a/website_docs": "website-docs", "https://github.com/a/tool_site": "tool-site"}
    assert one_column(spark, names, crawl.repo_name) == names
    refs = one_column(spark, ["https://github.com/o/r/tree/feature/x/docs", "https://github.com/o/r"], crawl.tree_url)
    assert [tuple(r) for r in refs.values()] == [("https://github.com/o/r", "feature/x/docs"), ("https://github.com/o/r", None)]


def test_names_and_paths_of_urls(spark):
    slugs = {"https://overreacted.io/": "overreacted.io", "https://overreacted.io/things-i-dont-know-as-of-2018/": "overreacted.io-things-i-dont-know-as-of-2018", "https://www.example.com/article/hello-world": "example.com-article-hello-world", "https://site.com/a_b.c/d+e": "site.com-a-b-c-d-e"}
    assert one_column(spark, slugs, lambda _: crawl.suggested_name("v")) == slugs
    paths = {"https://x.org:8443/a/b/": "x.org:8443/a/b.md", "https://x.org": "x.org/index.md", "https://x.org/g.TXT": "x.org/g.TXT", "https://x.org/p.htm?q": "x.org/p.htm"}
    assert one_column(spark, paths, lambda _: crawl.path_of("v", ".md")) == paths
    sites = spark.createDataFrame([("https://www.prisma.io/docs",), ("https://a.com/",), ("https://mui.com/x/llms.txt",)], "url string")
    got = sorted((r.url, r.ord, r.candidate) for r in crawl.index_candidates(sites).collect())
    assert [c for *_, c in got] == ["https://a.com/llms-full.txt", "https://a.com/llms.txt", "https://mui.com/x/llms.txt", "https://www.prisma.io/docs/llms-full.txt", "https://www.prisma.io/docs/llms.txt"]


def test_links_of_one_host_in_other_words(spark):
    """Ports, users, case and dot segments don't hide that a link stays on its index's host, nor a page from its link."""
    base = "https://h.org/llms.txt"
    raw = ["https://h.org:443/a", "https://u@h.org/b", "https://H.ORG/f/../g", "./g", "https://h.org:8443/c", "http://h.org:443/d", "//h.org:99999/"]
    links = spark.createDataFrame([(1, i, "t", base, u) for i, u in enumerate(raw)], "doc_id int, line_no int, title string, base_url string, url string")
    found = crawl.resolved(links)
    assert [r.url for r in crawl.same_host_links(found).orderBy("rank").collect()] == ["https://h.org/a", "https://u@h.org/b", "https://h.org/g"]
    pages = spark.createDataFrame([("HTTPS://h.org:443/x/../g", "text"), ("https://h.org/a", " ")], "url string, body string")
    assert {r.line_no: r.ok for r in crawl.followed(found, pages).collect()} == {0: False, 1: False, 2: True, 3: True, 4: False, 5: False}


def test_triage(spark):
    html = "<HTML lang=en><body><article><p>Enough words to read here.</p></article></body></html>"
    rows = [(200, None, html, "html"), (200, "text/plain", html, "text"), (200, "application/zip", "PK", "text"), (200, "font/woff2", "x", "text"), (200, "Image/PNG", "x", "binary"), (200, "application/pdf; x", "x", "binary"), (503, None, "x", "HTTP 503"), (200, "text/html", " \n", "empty"), (200, "application/xhtml+xml", html, "html"), (200, "text/html", None, "empty")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, status int, content_type string, body string, want string").withColumn("content_length", F.lit(None).cast("long"))
    assert [r.reason or r.kind for r in crawl.triage(df).orderBy("i").collect()] == [w for *_, w in rows]
    assert [r.reason for r in crawl.triage(df.filter("i < 2"), F.lit(" ")).orderBy("i").collect()] == ["no readable article", None]


def test_packages_on_disk(spark, tmp_path):
    rows = lambda v, n: (spark.createDataFrame([("npm", "a", v, i, f"c{i}") for i in range(n)], "registry string, name string, version string, id long, content string"), spark.createDataFrame([("npm", "a", v, "name", "a")], "registry string, name string, version string, key string, value string"))
    for v, n in (("1.0", 3), ("2.0", 2), ("1.0", 5)):
        packages.write(*rows(v, n), str(tmp_path))
    assert {str(r.version): r.section_count for r in packages.read(spark, str(tmp_path)).collect()} == {"1.0": 5, "2.0": 2}
    out = packages.results_json(spark.createDataFrame([(1, "l", "v", [])], "query_id int, library string, version string, results array<struct<title:string>>"))
    assert "message" in json.loads(out.first().json)


def test_trees_archives_definitions_feeds(spark, tmp_path):
    (tmp_path / "tree/docs").mkdir(parents=True)
    (tmp_path / "tree/docs/a.md").write_text("é")
    assert [(r.path, r.content) for r in sources.read_tree(spark, str(tmp_path / "tree")).collect()] == [("docs/a.md", "é")]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("docs/a.md", "A")
        z.writestr("docs/search.html", "S")
    (tmp_path / "bad.zip").write_bytes(b"no")
    entries = sources.read_archives(spark, str(tmp_path))
    assert [(r.rel_path, r.content) for r in corpus.archive_entries(entries, "docs").collect()] == [("a.md", "A")]
    (tmp_path / "defs/npm/@s").mkdir(parents=True)
    (tmp_path / "defs/npm/@s/lib.yaml").write_text("name: '@s/lib'\nversions:\n  - min_version: '1.0'\n    max_version: '2.0'\n  - versions: ['0.1']\n")
    defs = definitions.read_definitions(spark, str(tmp_path / "defs"))
    assert [(r.registry, r.name, r.entry_ord, r.min_version, r.versions) for r in definitions.version_entries(defs).orderBy("entry_ord").collect()] == [("npm", "@s/lib", 0, "1.0", None), ("npm", "@s/lib", 1, None, ["0.1"])]
    feeds = [("npm", "a", json.dumps({"versions": {"1.0.0": {"x": 1}, "2.0.0": {}}, "time": {"1.0.0": "2024-01-01T00:00:00.000Z"}})), ("pip", "b", json.dumps({"releases": {"1.0": [{"upload_time_iso_8601": "2024-01-02T00:00:00Z"}], "2.0": []}})), ("maven", "c", json.dumps({"response": {"docs": [{"v": "3.0", "timestamp": 1704067200000}]}})), ("hex", "d", json.dumps({"releases": [{"version": "1.7.0", "inserted_at": "2024-01-01T00:00:00Z"}]}))]
    got = definitions.releases_of_feeds(spark.createDataFrame(feeds, "registry string, name string, payload string")).collect()
    assert sorted((r.name, r.version, r.published_at is None) for r in got) == [("a", "1.0.0", False), ("a", "2.0.0", True), ("b", "1.0", False), ("b", "2.0", True), ("c", "3.0", False), ("d", "1.7.0", False)]


def test_dense_ids_over_ranges(spark):
    rows = list(itertools.product(["p", "q"], range(0, 30000, 700), range(3)))
    df = spark.createDataFrame(rows, "package_id string, file_ord long, section_ord int").repartition(5)
    got = sorted((r.package_id, r.file_ord, r.section_ord, r.id) for r in build.numbered(df).collect())
    assert [g[3] for g in got] == list(range(1, len(rows) // 2 + 1)) * 2


def test_dense_ids_of_sparse_files(spark):
    """One package holds most files, whose numbers are far apart."""
    rows = [("hot", i * 1_000_003, k) for i in range(800) for k in range(2)] + [("cold", 5, 0), (None, 1, 0)]
    df = spark.createDataFrame(rows, "package_id string, file_ord long, section_ord int").repartition(7)
    got = sorted((r.file_ord, r.section_ord, r.id) for r in build.dense_ids(df).filter("package_id = 'hot'").collect())
    assert [g[2] for g in got] == list(range(1, 1601))
