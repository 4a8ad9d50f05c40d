"""Web addresses parsed by the URL standard, as SQL expressions.

``parsed`` goes through the standard's states in order: clean-up, scheme, authority (user, host, port), path with its dot
segments, query and fragment, each against a base where the address is relative. It gives a struct, or null where the
standard fails. The parts are composed as SQL text, which Spark reads in one go (built call by call, such a tree takes
seconds on the driver); a value that is used again is bound once by ``let``. Addresses that are already in their final
form, which most are, are recognised by one pattern and skip the rest.

Limits: IPv6 hosts are put in lower case but not shortened; hosts of other letters than ASCII follow the older rule of
the Java library (``ß`` becomes ``ss``); of schemes other than those below, all behind the scheme counts as the path.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the standard: schemes with a host and their ports, what each part has in percent form (beside controls
# and letters beyond ASCII), what no host may hold. \x22 and \x27 are the two quotes.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
USER_SET = r"\x20\x22#<>?`{}/:;=@\[\\\]^|"
PATH_SET = r"\x20\x22#<>?`{}"
QUERY_SET = r"\x20\x22#<>\x27"
FRAGMENT_SET = r"\x20\x22<>`"
CONTROLS = r"\x{00}-\x{1F}\x{7F}-\x{10FFFF}"
NO_HOST = r"[\x{00}-\x20#%/:<>?@\[\\\]^|\x{7F}]"
ASCII = r"^[\x{00}-\x{7F}]*\z"
#: Final form: lower-case host that is no number, no default port, clean path without dot segments.
CLEAN = r"A-Za-z0-9%_.~!$&()*+,;=:@/"
FINAL = (
    r"^https?://(?!(?:[^/]*\.)?(?:[0-9]+|0x[0-9a-f]*)\.?(?::[0-9]+)?/)[a-z0-9_.-]+(?::(?!80/|443/)[1-9][0-9]{0,3})?"
    rf"(?:/(?!(?:\.|%2[eE]){{1,2}}(?:[/?#]|$))[{CLEAN.replace('/', '')}\x27-]*)+(?:\?[{CLEAN}?-]*)?(?:#[{CLEAN}?-]*)?\z"
)
PARTS = ("scheme", "user", "host", "port", "path", "query", "fragment")
_names = count()


def let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is computed once, however often it is used."""
    name = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def case(*pairs: tuple[str, str], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def matches(text: str, pattern: str) -> str:
    return f"rlike({text}, r'{pattern}')"


def group(text: str, pattern: str, number: int = 0) -> str:
    return f"regexp_extract({text}, r'{pattern}', {number})"


def swapped(text: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({text}, r'{pattern}', '{new}')"


def struct(names: tuple[str, ...], *values: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', string({v})" for n, v in zip(names, values, strict=True)) + ")"


def has_host(scheme: str) -> str:
    return f"{scheme} IN ({', '.join(repr(p) for p in PORTS)})"


def encoded(text: str, extra: str) -> str:
    """Controls, letters beyond ASCII and the given characters in percent form."""
    odd = f"[{CONTROLS}{extra}]"
    form = case((matches("c", odd), "regexp_replace(hex(encode(c, 'UTF-8')), '(..)', '%$1')"), other="c")
    return let(text, lambda t: case((matches(t, odd), f"array_join(transform(regexp_extract_all({t}, '(?s).', 0), c -> {form}), '')"), other=t))


def _number(label: str) -> str:
    """A part of an address of numbers: decimal, octal after 0, hexadecimal after 0x; null if it is none or far too large."""
    hexa, octal = group(label, "^0[xX]0*([0-9a-fA-F]+)$", 1), group(label, "^0+([0-7]*)$", 1)
    return case(
        (matches(label, "^0[xX]$"), "0L"),
        (matches(label, "^0[xX]"), f"CASE WHEN length({hexa}) BETWEEN 1 AND 8 THEN bigint(conv({hexa}, 16, 10)) END"),
        (matches(label, "^0+$"), "0L"),
        (matches(label, "^0"), f"CASE WHEN length({octal}) BETWEEN 1 AND 11 THEN bigint(conv({octal}, 8, 10)) END"),
        (matches(label, "^[0-9]{1,10}$"), f"bigint({label})"),
    )


def _numeric_host(host: str) -> str:
    """The dotted form of a host whose last label is a number, or null."""
    labels = f"transform(split({swapped(host, '[.]$')}, '[.]'), n -> {_number('n')})"

    def dotted(x: str) -> str:
        before = f"slice({x}, 1, size({x}) - 1)"
        value = f"aggregate({before}, named_struct('sum', element_at({x}, -1), 'left', 24), (a, v) -> named_struct('sum', a.sum + shiftleft(v, a.left), 'left', a.left - 8), a -> a.sum)"
        good = f"size({x}) <= 4 AND forall({x}, v -> v IS NOT NULL) AND forall({before}, v -> v < 256) AND element_at({x}, -1) < shiftleft(1L, 8 * (5 - size({x})))"
        parts = lambda v: "concat_ws('.', " + ", ".join(f"string(shiftright({v}, {k}) & 255)" for k in (24, 16, 8, 0)) + ")"
        return case((good, let(value, parts)))

    return let(labels, dotted)


def _host(given: str) -> str:
    """A host in its final form, or null."""
    label = case((matches("x", ASCII), "lower(x)"), other="lower(try_reflect('java.net.IDN', 'toASCII', x))")
    whole = lambda x: f"CASE WHEN forall({x}, y -> y IS NOT NULL) THEN array_join({x}, '.') END"
    low = lambda h: case((matches(h, ASCII), f"lower({h})"), other=let(f"transform(split({h}, '[.。．｡]'), x -> {label})", whole))
    number = r"(^|[.])([0-9]+|0[xX][0-9a-fA-F]*)[.]?$"
    checked = lambda d: case((f"{d} = '' OR {matches(d, NO_HOST)}", "NULL"), (matches(d, number), _numeric_host(d)), other=d)
    decoded = f"CASE WHEN contains({given}, '%') THEN try_url_decode(replace({given}, '+', '%2B')) ELSE {given} END"
    literal = f"{matches(given, '^.[0-9a-fA-F:.]*:[0-9a-fA-F:.]*]$')} AND NOT {matches(given, ':::|::.*::')}"
    return case((f"startswith({given}, '[')", f"CASE WHEN {literal} THEN lower({given}) END"), other=let(decoded, lambda d: let(low(d), checked)))


def _user(given: str) -> str:
    """User and password in percent form with their at sign; nothing if both are empty."""
    both = lambda w: f"concat({encoded(group(given, '(?s)^[^:]*'), USER_SET)}, CASE WHEN {w} = '' THEN '' ELSE concat(':', {encoded(w, USER_SET)}) END)"
    return let(let(group(given, "(?s)^[^:]*:(.*)$", 1), both), lambda x: f"CASE WHEN {x} = '' THEN '' ELSE concat({x}, '@') END")


def without_dots(path: str) -> str:
    """The path with its dot segments carried out; it begins with a slash."""
    one, two = r"^([.]|%2[eE])$", r"^([.]|%2[eE]){2}$"
    held = case((matches("x", two), "slice(a.held, 1, greatest(size(a.held) - 1, 0))"), (matches("x", one), "a.held"), other="concat(a.held, array(x))")
    step = f"named_struct('held', {held}, 'dot', {matches('x', '^([.]|%2[eE]){1,2}$')})"
    ended = "concat('/', array_join(CASE WHEN a.dot THEN concat(a.held, array('')) ELSE a.held END, '/'))"
    done = lambda p: f"aggregate(split(substring({p}, 2), '/'), named_struct('held', cast(array() AS array<string>), 'dot', false), (a, x) -> {step}, a -> {ended})"
    return let(path, lambda p: case((matches(p, "/([.]|%2[eE]){1,2}(/|$)"), done(p)), other=p))


def _authority(scheme: str, text: str) -> str:
    """Scheme, user, host, port and path as written of a text that begins with an authority, or null."""
    host_port = r"^(\[[^\[\]]*\]|[^:\[\]]*)(?::0*([0-9]*))?$"
    usual = f"map({', '.join(f'{s!r}, {p}' for s, p in PORTS.items())})[{scheme}]"

    def split(a: str) -> str:
        path = f"substring({text}, char_length({a}) + 1)"
        user = f"CASE WHEN contains({a}, '@') THEN {_user(swapped(a, '(?s)@[^@]*$'))} ELSE '' END"

        def parts(own: str) -> str:
            digits = group(own, host_port, 2)
            port = case((matches(own, ":0+$"), "':0'"), (f"{digits} = '' OR int({digits}) = {usual}", "''"), other=f"concat(':', {digits})")
            good = f"{matches(own, host_port)} AND length({digits}) <= 5 AND ({digits} = '' OR int({digits}) <= 65535)"
            made = lambda h: f"CASE WHEN {h} IS NOT NULL THEN {struct(PARTS[:5], scheme, user, h, port, swapped(path, '^$', '/'))} END"
            return let(f"CASE WHEN {good} THEN {_host(group(own, host_port, 1))} END", made)

        return let(swapped(a, "(?s)^.*@"), parts)

    return let(group(text, "^[^/]*"), split)


def parsed(url: str, base: str | None = None) -> str:
    """(scheme, user, host, port, path, query, fragment) of an address, or null; SQL text of a struct from SQL texts.

    User, port, query and fragment hold their marks; those that aren't there are empty. ``base`` is a parsed address.
    """
    form = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?([^?#]*)(\?[^#]*)?(#.*)?$"
    cleared = swapped(swapped(url, r"^[\x{00}-\x20]+|[\x{00}-\x20]+$"), r"[\t\n\r]")
    marked = lambda part, extra: f"concat(substring({part}, 1, 1), {encoded(f'substring({part}, 2)', extra)})"

    def pieces(s: str) -> str:
        cut = f"named_struct('scheme', lower({group(s, form, 1)}), 'rest', {group(s, form, 2)}, 'query', {group(s, form, 3)}, 'fragment', {group(s, form, 4)})"
        rest = lambda c: f"CASE WHEN {c}.scheme = '' OR {has_host(f'{c}.scheme')} THEN translate({c}.rest, '\\\\', '/') ELSE {encoded(f'{c}.rest', '')} END"
        return let(cut, lambda c: f"named_struct('scheme', {c}.scheme, 'rest', {rest(c)}, 'slashes', startswith({c}.rest, '//'), 'query', {marked(f'{c}.query', QUERY_SET)}, 'fragment', {marked(f'{c}.fragment', FRAGMENT_SET)})")

    def states(c: str) -> str:
        stripped, special = swapped(f"{c}.rest", "^/+"), has_host(f"{c}.scheme")
        other = struct(PARTS[:5], f"{c}.scheme", "''", "''", "''", f"{c}.rest")
        query = f"{c}.query"
        if base is None:
            origin = case((f"{c}.scheme = ''", "NULL"), (special, _authority(f"{c}.scheme", stripped)), other=other)
        else:
            relative = f"({c}.scheme = '' OR ({special} AND {base}.scheme = {c}.scheme AND NOT {c}.slashes))"
            hosted = case((f"NOT {relative} AND {special}", f"{c}.scheme"), (f"{relative} AND startswith({c}.rest, '//') AND {base}.host <> ''", f"{base}.scheme"))
            merged = case((f"{c}.rest = ''", f"{base}.path"), (f"startswith({c}.rest, '/')", f"{c}.rest"), other=f"concat({swapped(f'{base}.path', '[^/]*$')}, {c}.rest)")
            beside = f"CASE WHEN {base}.host <> '' THEN {struct(PARTS[:5], *(f'{base}.{p}' for p in PARTS[:4]), merged)} END"
            origin = let(hosted, lambda h: case((f"{h} IS NOT NULL", _authority(h, stripped)), (relative, beside), other=other))
            query = case((f"{relative} AND {c}.rest = '' AND {c}.query = ''", f"{base}.query"), other=query)

        def whole(o: str) -> str:
            path = case((f"{o}.host = ''", f"{o}.path"), other=without_dots(encoded(f"{o}.path", PATH_SET)))
            return f"CASE WHEN {o} IS NOT NULL THEN {struct(PARTS, *(f'{o}.{p}' for p in PARTS[:4]), path, query, f'{c}.fragment')} END"

        return let(origin, whole)

    cut = r"^([a-z]+)://([a-z0-9_.-]+)((?::[0-9]+)?)(/[^?#]*)((?:\?[^#]*)?)((?:#.*)?)$"
    final = struct(PARTS, group(url, cut, 1), "''", *(group(url, cut, k) for k in range(2, 7)))
    return case((matches(url, FINAL), final), (f"{url} IS NOT NULL", let(let(cleared, pieces), states)))


def href(u: str) -> str:
    """The text of a parsed address."""
    mark = f"CASE WHEN {has_host(f'{u}.scheme')} THEN '://' ELSE ':' END"
    return f"concat({u}.scheme, {mark}, " + ", ".join(f"{u}.{p}" for p in PARTS[1:]) + ")"


def final_form(url: str) -> Column:
    """The address as the standard writes it, or null. ``url`` is a column's name or SQL text, here and below."""
    return F.expr(let(parsed(url), href))


def joined(base: str, url: str) -> Column:
    """An address, relative or not, against a base; null if the standard can't resolve it."""
    against = lambda b: f"CASE WHEN {b} IS NOT NULL THEN {case((matches(url, FINAL), url), other=let(parsed(url, b), href))} END"
    return F.expr(let(parsed(base), against))


def part(url: str, text: Callable[[str], str]) -> Column:
    """An expression of a parsed address; ``text`` gives it as SQL."""
    return F.expr(let(parsed(url), text))


def origin_host(url: str) -> Column:
    """Host with the port that isn't the scheme's own."""
    return part(url, lambda u: f"concat({u}.host, {u}.port)")
