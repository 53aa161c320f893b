"""The text and answer rules as SQL expressions for the oracle engine. Each takes and gives a SQL expression."""

from __future__ import annotations

from collections.abc import Callable

NUM = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"
NESTED = r"'\\boxed\{([^{}]+(?:\{[^{}]*\}[^{}]*)*)\}'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def bare(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', '', 'g')"


def number(x: str) -> str:
    return f"""(case when regexp_matches({x}, {NUM}) then try_cast(trim({x}) as double)
      when regexp_matches({x}, '(?i)^\\s*[+-]?inf(inity)?\\s*$') then case when contains({x}, '-') then '-inf'::double else 'inf'::double end
      when regexp_matches({x}, '(?i)^\\s*[+-]?nan\\s*$') then 'nan'::double end)"""


def loose_number(x: str) -> str:
    s = f"replace({strip(x)}, ',', '')"
    return f"(case when ends_with({s}, '%') then {number(f'left({s}, length({s}) - 1)')} / 100.0::double else {number(s)} end)"


def plain_fraction(x: str) -> str:
    return rf"regexp_replace({x}, '\\dfrac\{{(.*?)\}}\{{(.*?)\}}', '\\frac{{\1}}{{\2}}', 'g')"


def group(x: str, pattern: str, g: int) -> str:
    return f"(case when regexp_matches({x}, {pattern}) then regexp_extract({x}, {pattern}, {g}) end)"


FRACTION = r"'^\\frac\{(\d+)\}\{(\d+)\}'"
ANY_FRACTION = r"'^\\frac\{(.*)\}\{(.*)\}'"


def near(a: str, b: str) -> str:
    """Null if either is null; not-a-number and infinities are near nothing."""
    return f"(case when {a} is null or {b} is null then null when isnan({a}) or isnan({b}) or isinf({a}) or isinf({b}) then false else abs({a} - {b}) < 1e-6 end)"


def last_box(x: str) -> str:
    return f"list_extract(regexp_extract_all({x}, {NESTED}, 1), -1)"


def prepared(source: str, steps: list[tuple[str, str]]) -> str:
    """Named columns one after another, each usable in the next: nested selects over ``source``."""
    out = source
    for i, (name, expression) in enumerate(steps):
        out = f"(select *, {expression} as {name} from {out} s{i})"
    return out


def plain(source: str) -> str:
    return prepared(source, [("na", number("a")), ("nb", number("b")), ("same", f"coalesce({near('na', 'nb')}, {strip('a')} = {strip('b')}, false)")])


def _fractions(source: str, clean: str, opened: bool, text: Callable[[str], str] | None = None) -> str:
    a, b = ("a1", "b1")
    steps = [("a1", plain_fraction(clean.format("a"))), ("b1", plain_fraction(clean.format("b")))]
    if opened:
        steps += [("xa", last_box("a1")), ("xb", last_box("b1")), ("a2", "case when xa is not null and xb is not null then xa else a1 end"), ("b2", "case when xa is not null and xb is not null then xb else b1 end")]
        a, b = ("a2", "b2")
    text = text or (bare if opened else strip)
    for side, c in (("a", a), ("b", b)):
        steps += [(f"t{side}", f"cast({group(c, FRACTION, 1)} as double)"), (f"u{side}", f"cast({group(c, FRACTION, 2)} as double)"), (f"n{side}", f"coalesce(case when u{side} <> 0 then t{side} / u{side} end, {number(c)})")]
    return prepared(source, [*steps, ("same", f"coalesce(ua, 1) <> 0 and coalesce(ub, 1) <> 0 and coalesce({near('na', 'nb')}, {text(a)} = {text(b)}, false)")])


def with_fractions(source: str) -> str:
    return _fractions(source, "{}", False)


UNQUOTED = f"trim({strip('{}')}, chr(34) || chr(39))"


def lenient(source: str) -> str:
    return _fractions(source, UNQUOTED, True)


def lenient_opened(source: str) -> str:
    """``lenient`` of texts whose boxes have been opened."""
    return _fractions(source, UNQUOTED, False, bare)


def loose(source: str) -> str:
    steps = [("a1", plain_fraction("a")), ("b1", plain_fraction("b"))]
    for side in "ab":
        c = f"{side}1"
        steps += [(f"ta{side}", group(c, ANY_FRACTION, 1)), (f"ua{side}", group(c, ANY_FRACTION, 2)), (f"t{side}", loose_number(f"ta{side}")), (f"u{side}", loose_number(f"ua{side}"))]
        steps += [(f"n{side}", f"coalesce(case when u{side} <> 0 then t{side} / u{side} end, {loose_number(c)})")]
    clean = lambda x: strip(f"replace({strip(x)}, ',', '')")
    return prepared(source, [*steps, ("same", f"coalesce({near('na', 'nb')}, {clean('a1')} = {clean('b1')}, false)")])


def numbers(x: str) -> str:
    return rf"regexp_extract_all({x}, '([-+]?\d*\.\d+|\d+)', 1)"


def by_numbers(source: str) -> str:
    inner = plain(source)
    steps = [("p", numbers("a")), ("q", numbers("b")), ("far", "len(list_filter(list_zip(p, q), lambda z: abs(z[1]::double - z[2]::double) > 1e-6))")]
    return prepared(f"(select a, b, same as same1 from {inner} w)", [*steps, ("same", f"same1 or coalesce(len(p) = len(q) and far = 0, false) or coalesce({bare('a')} = {bare('b')}, false)")])
