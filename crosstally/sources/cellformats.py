"""What a workbook shows for a number: number format codes (of styles, built in or custom) read into functions.

A code has up to four sections, divided by semicolons: positive, negative, zero numbers and text, or sections with conditions.
A section shows a date or time, a number, a fraction, or "General". Codes are compiled once per task; rows only call the result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Context, Decimal
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Number formats that the workbook standard numbers but doesn't write into files (en-US).
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00",
    5: '"$"#,##0_);("$"#,##0)', 6: '"$"#,##0_);[Red]("$"#,##0)', 7: '"$"#,##0.00_);("$"#,##0.00)', 8: '"$"#,##0.00_);[Red]("$"#,##0.00)',
    9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss",
    22: "m/d/yy h:mm", 37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)",
    41: '_(* #,##0_);_(* (#,##0);_(* "-"_);_(@_)', 42: '_("$"* #,##0_);_("$"* (#,##0);_("$"* "-"_);_(@_)',
    43: '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_);_(@_)', 44: '_("$"* #,##0.00_);_("$"* (#,##0.00);_("$"* "-"??_);_(@_)',
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
# English names as workbooks show them.
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
#: Shown for a date before the calendar's first day.
NO_DATE = "########"

_TOKEN = re.compile(
    r'"(?P<quoted>[^"]*)"?|\\(?P<escaped>.)|[_*](?P<spacer>.)|\[(?P<bracket>[^\]]*)\]|(?P<general>General)|(?P<half>AM/PM|A/P)'
    r"|(?P<exponent>E[+-])|(?P<date>y+|m+|d+|h+|s+|\.0+(?=$|[^0#?]))|(?P<digit>[0#?])|(?P<sign>[.,%/])|(?P<other>.)",
    re.IGNORECASE | re.DOTALL)
_CONDITION = re.compile(r"(<=|>=|<>|<|>|=)\s*(-?[\d.]+)")
_COMPARE = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "=": lambda a, b: a == b,
            "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<>": lambda a, b: a != b}

Token = tuple[str, str]


def _tokens(section: str) -> tuple[list[Token], Callable | None]:
    """Parts of a section and its condition; colours, spacers and locales show nothing, a currency shows its symbol."""
    out: list[Token] = []
    condition = None
    for match in _TOKEN.finditer(section):
        kind, text = match.lastgroup, match.group(match.lastgroup)
        if kind in ("quoted", "escaped", "other"):
            out.append(("text", text))
        elif kind == "bracket":
            found = _CONDITION.fullmatch(text)
            if found:
                compare, bound = _COMPARE[found[1]], Decimal(found[2])
                condition = lambda value: compare(value, bound)
            elif re.fullmatch(r"h+|m+|s+", text, re.IGNORECASE):
                out.append(("elapsed", text.lower()))
            elif text.startswith("$"):
                out.append(("text", text[1:].split("-")[0]))
        elif kind != "spacer":
            out.append((kind, text))
    return out, condition


def _sections(code: str) -> list[str]:
    """The code cut at semicolons that are neither quoted nor escaped."""
    return ["".join(parts) for parts in _split(re.findall(r'"[^"]*"?|[\\_*].|\[[^\]]*\]|.', code, re.DOTALL))]


def _split(parts: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for part in parts:
        if part == ";":
            out.append([])
        else:
            out[-1].append(part)
    return out


def general(value: float) -> str:
    """At most ten significant digits; very large and very small numbers with an exponent."""
    size = abs(value)
    exact = Decimal(repr(value))
    if size and (size >= 1e11 or size <= 1e-10):
        short = Context(prec=6, rounding=ROUND_HALF_UP).create_decimal(exact)
        digits, exponent = f"{short:.5E}".split("E")
        return f"{digits.rstrip('0').rstrip('.')}E{int(exponent):+d}"
    if exact == exact.to_integral_value():
        return str(int(exact))
    rounded = Context(prec=10, rounding=ROUND_HALF_UP).create_decimal(exact)
    text = f"{rounded:f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def _with_points(tokens: list[Token]) -> list[Token]:
    """Zeros after a point are decimals here, not parts of a second."""
    return [p for k, t in tokens
            for p in ([("sign", "."), *[("digit", "0")] * (len(t) - 1)] if k == "date" and t[0] == "." else [(k, t)])]


def _layout(tokens: list[Token]) -> dict:
    """Where digits stand before and after the point and in the exponent, and what commas and percent signs say."""
    places = [i for i, (k, _) in enumerate(tokens) if k == "digit"]
    power = next((i for i, (k, _) in enumerate(tokens) if k == "exponent"), len(tokens))
    point = next((i for i, t in enumerate(tokens[:power]) if t == ("sign", ".")), None)
    end = point if point is not None else power
    whole = [i for i in places if i < end]
    last = max([i for i in places if i < power], default=-1)
    commas = [i for i, t in enumerate(tokens[:power]) if t == ("sign", ",")]
    return {
        "whole": whole, "part": [i for i in places if end < i < power], "tail": [i for i in places if i > power], "power": power,
        "hidden": set(commas), "grouped": any(whole and whole[0] < i < whole[-1] for i in commas),
        "scale": 3 * sum(i > max(whole, default=last) and (i < end or i > last) for i in commas) if places else 0,
        "percents": sum(t == ("sign", "%") for t in tokens)}


def _pattern(tokens: list[Token]) -> Callable[[Decimal], str]:
    """A number without its sign by digit placeholders, grouping, scaling, percent and exponent."""
    tokens = _with_points(tokens)
    lay = _layout(tokens)
    whole, part, tail, power, hidden = (lay[name] for name in ("whole", "part", "tail", "power", "hidden"))
    grouped, scale, percents = lay["grouped"], lay["scale"], lay["percents"]

    def show(value: Decimal) -> str:
        value = value.scaleb(2 * percents - scale)
        exponent = 0
        if power < len(tokens):
            width = max(1, len(whole))
            if value:
                exponent = value.adjusted() // width * width if width > 1 else value.adjusted()
            value = value.scaleb(-exponent)
            rounded = value.quantize(Decimal(1).scaleb(-len(part)), ROUND_HALF_UP)
            if rounded >= Decimal(1).scaleb(width):
                exponent, rounded = exponent + width, rounded.scaleb(-width)
            value = rounded
        digits = f"{value.quantize(Decimal(1).scaleb(-len(part)), ROUND_HALF_UP, Context(prec=400)):f}"
        front, _, back = digits.partition(".")
        put = {**_front(front.lstrip("0"), whole, tokens, grouped), **_back(back, part, tokens)}
        if tail:
            put |= _front(str(abs(exponent)), tail, tokens, False)
        out = []
        for i, (kind, text) in enumerate(tokens):
            if kind == "exponent":
                out.append("E" + ("-" if exponent < 0 else "+" if text[1] == "+" else ""))
            elif kind == "digit":
                out.append(put[i])
            elif i not in hidden:
                if kind == "sign" and text == "." and not whole:
                    out.append(front.lstrip("0"))
                out.append(text)
        return "".join(out)

    return show


def _front(digits: str, places: list[int], tokens: list[Token], grouped: bool) -> dict[int, str]:
    """Digits put on placeholders from the right; the first takes all that are left."""
    if not places:
        return {}
    width = len(places)
    digits = digits if len(digits) >= width else digits.rjust(width, "\0")
    put = {}
    for n, i in enumerate(places):
        group = digits[: len(digits) - width + 1] if n == 0 else digits[len(digits) - width + n]
        shown = []
        for j, digit in enumerate(group):
            left = width - 1 - n + len(group) - 1 - j  # digits to the right
            if digit == "\0":
                digit = {"0": "0", "#": "", "?": " "}[tokens[i][1]]
            shown.append(digit + ("," if grouped and left and left % 3 == 0 and digit.isdigit() else ""))
        put[i] = "".join(shown)
    return put


def _back(digits: str, places: list[int], tokens: list[Token]) -> dict[int, str]:
    """Decimals on their placeholders; zeros at the end are shown by ``0`` only."""
    put, needed = {}, False
    for n in range(len(places) - 1, -1, -1):
        digit, i = digits[n], places[n]
        needed = needed or digit != "0" or tokens[i][1] == "0"
        put[i] = digit if needed else {"#": "", "?": " "}[tokens[i][1]]
    return put


def _fraction_kind(tokens: list[Token]) -> tuple[int | None, int, bool]:
    """A fixed denominator, else the largest one; and whether a whole number stands before."""
    slash = tokens.index(("sign", "/"))
    text = "".join(t for _, t in tokens[slash + 1 :]).strip()
    fixed = re.match(r"\d+", text)
    fixed = int(fixed[0]) if fixed and int(fixed[0]) else None
    most = 10 ** max(1, sum(k == "digit" for k, _ in tokens[slash + 1 :])) - 1
    before = "".join(t for _, t in tokens[:slash])
    mixed = re.search(r"[0#?]\s+[0#?]+\s*$", before) is not None
    return fixed, most, mixed


def _fraction(tokens: list[Token]) -> Callable[[Decimal], str]:
    """Whole number and fraction, or a fraction alone; by a fixed denominator or the nearest with as many digits."""
    fixed, most, mixed = _fraction_kind(tokens)

    def show(value: Decimal) -> str:
        exact = Fraction(value)
        whole = int(exact) if mixed else 0
        rest = exact - whole
        near = Fraction(round(rest * fixed), fixed) if fixed else rest.limit_denominator(most)
        if mixed and near == 1:
            whole, near = whole + 1, Fraction(0)
        top, bottom = (near * fixed, fixed) if fixed else (near.numerator, near.denominator)
        if mixed and not near:
            return str(whole)
        return (f"{whole} " if whole else "") + f"{top}/{bottom}"

    return show


def _minutes(tokens: list[Token]) -> set[int]:
    """Which m stand for minutes: those next to hours or seconds."""
    clock = [i for i, (k, t) in enumerate(tokens) if k in ("date", "elapsed") and t[0].lower() in "hms"]
    minutes = set()
    for n, i in enumerate(clock):
        if tokens[i][1][0].lower() == "m" and tokens[i][0] == "date" and len(tokens[i][1]) <= 2:
            earlier = n and tokens[clock[n - 1]][1][0].lower() in "h"
            later = n + 1 < len(clock) and tokens[clock[n + 1]][1][0].lower() == "s"
            if earlier or later:
                minutes.add(i)
    return minutes


def _moment(tokens: list[Token], from_1904: bool) -> Callable[[Decimal], str]:
    """A day number as date and time. Days before March 1900 follow the calendar's extra 29 February."""
    minutes = _minutes(tokens)
    half = any(k == "half" for k, _ in tokens)

    def show(value: Decimal) -> str:
        if value < 0:
            return NO_DATE
        day = int(value)
        ms = int(((value - day) * 86_400_000).quantize(Decimal(1), ROUND_HALF_UP))
        day, ms = day + ms // 86_400_000, ms % 86_400_000
        total = day * 86_400_000 + ms
        leap = day == 60 and not from_1904
        try:
            at = date(1904, 1, 1) + timedelta(day) if from_1904 else date(1899, 12, 31 if day < 60 else 30) + timedelta(day - leap)
        except OverflowError:
            return NO_DATE
        number = 29 if leap else at.day
        hour, minute, second = ms // 3_600_000, ms // 60_000 % 60, ms // 1000 % 60
        out = []
        for i, (kind, text) in enumerate(tokens):
            low, n = text.lower(), len(text)
            if kind == "elapsed":
                out.append(str(total // {"h": 3_600_000, "m": 60_000, "s": 1000}[low[0]]).zfill(n))
            elif kind == "half":
                name = "AM" if hour < 12 else "PM"
                out.append(name if len(text) == 5 else name[0])
            elif kind != "date":
                out.append(text)
            elif low[0] == ".":
                out.append("." + f"{ms % 1000:03d}"[: n - 1].ljust(n - 1, "0"))
            elif low[0] == "y":
                out.append(f"{at.year % 100:02d}" if n <= 2 else f"{at.year:04d}")
            elif low[0] == "d":
                out.append(str(number).zfill(n) if n <= 2 else DAYS[at.weekday()][: 3 if n == 3 else None])
            elif low[0] == "h":
                out.append(str((hour + 11) % 12 + 1 if half else hour).zfill(min(n, 2)))
            elif low[0] == "s":
                out.append(str(second).zfill(min(n, 2)))
            elif i in minutes:
                out.append(str(minute).zfill(min(n, 2)))
            else:
                name = MONTHS[at.month - 1]
                out.append({3: name[:3], 5: name[0]}.get(n, name) if n > 2 else str(at.month).zfill(n))
        return "".join(out)

    return show


def _shown(tokens: list[Token], from_1904: bool) -> tuple[Callable[[Decimal], str], bool]:
    """What shows a number in this section, and whether it takes the sign itself (dates do)."""
    kinds = {k for k, _ in tokens}
    # Zeros after a point are parts of a second only beside parts of a time.
    if any(k in ("half", "elapsed") or k == "date" and t[0] != "." for k, t in tokens):
        return _moment(tokens, from_1904), True
    if "general" in kinds or ("text", "@") in tokens:
        return lambda v: "".join(general(float(v)) if k == "general" or t == "@" else t for k, t in tokens), False
    if ("sign", "/") in tokens and "digit" in kinds:
        return _fraction(tokens), False
    return _pattern(tokens), False


@lru_cache(maxsize=4096)
def compiled(code: str, from_1904: bool = False) -> Callable[[float], str]:
    """What cells of this format show for a number.

    Rounding is half up on the shortest decimal text of the number. Spacers and fillers (``_x``, ``*x``) show nothing. An empty
    section shows nothing. A negative number gets a minus in a section that isn't for negative numbers by its place, unless
    nothing but zeros is left of it.
    """
    if not code or code.strip().lower() in ("general", "@"):
        return general
    parts = [_tokens(s) for s in _sections(code)[:3]]
    shown = [(*_shown(tokens, from_1904), condition, bool(tokens)) for tokens, condition in parts]
    conditional = any(condition for *_, condition, _ in shown)

    def show(number: float) -> str:
        value = Decimal(repr(number))
        if conditional:
            at = next((i for i, (*_, c, _) in enumerate(shown) if c is None or c(value)), len(shown) - 1)
            signed = True
        else:
            at = 1 if value < 0 and len(shown) > 1 else 2 if not value and len(shown) > 2 else 0
            signed = at == 0
        render, takes_sign, _, some = shown[at]
        if not some:
            return ""
        if takes_sign:
            return render(value if signed else abs(value))
        text = render(abs(value))
        minus = value < 0 and signed and any(c in "123456789" for c in text)
        return ("-" if minus else "") + text

    return show


# Whole columns. What follows shows many numbers at once, as arrays, and gives the same texts: rounding is exact, and numbers or
# sections that arrays don't cover are left to ``compiled``.

Shown = tuple[pa.Array, np.ndarray]  # texts, and which of them are covered
_TENS = np.array([float(f"1e{n}") for n in range(23)])  # exact as doubles
_BY_TEN = np.array([float(f"1e{n}") for n in range(-17, 18)])
_DAY_MS = 86_400_000


@lru_cache(maxsize=4096)
def _table(*texts: str) -> pa.Array:
    return pa.array(texts, pa.string())


@lru_cache(maxsize=64)
def _counted(pattern: str, count: int) -> pa.Array:
    return pa.array([pattern.format(n) for n in range(count)], pa.string())


def _taken(table: pa.Array, at: np.ndarray) -> pa.Array:
    return table.take(pa.array(at))


def _joined(pieces: list[pa.Array | str]) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p) if isinstance(p, str) else p for p in pieces], "")


def placed(count: int, pieces: list[tuple[np.ndarray, pa.Array]]) -> pa.Array:
    """Texts put at their places, each place given once."""
    if len(pieces) == 1:
        return pieces[0][1]
    order = np.empty(count, np.int64)
    order[np.concatenate([at for at, _ in pieces])] = np.arange(count)
    return pa.concat_arrays([texts for _, texts in pieces]).take(pa.array(order))


def _half_up(values: np.ndarray, power: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers' shortest decimal texts times a power of ten, rounded half up, and where that is exact.

    A number rounds up if it isn't below the double next to the tie. Texts of at most 15 digits have doubles of their own, so only
    the tie itself meets its double.
    """
    with np.errstate(all="ignore"):
        fits = (np.abs(power) < len(_TENS)) & (values < 1e15)
        power = np.where(fits, power, 0)
        up, down = _TENS[np.maximum(power, 0)], _TENS[np.maximum(-power, 0)]
        scaled = values * up / down
        fits &= scaled < 1e14
        whole = np.floor(np.where(fits, scaled, 0))
        tie = (2 * whole + 1) * down / (2 * up)
        return (whole + (values >= tie)).astype(np.int64), fits


def _grouped(numbers: np.ndarray) -> pa.Array:
    """Whole numbers with a comma before each three digits."""
    large = numbers >= 1000
    if not large.any():
        return pa.array(numbers).cast(pa.string())
    front, back = np.divmod(numbers[large], 1000)
    return placed(len(numbers), [
        (np.flatnonzero(large), _joined([_grouped(front), _taken(_counted(",{:03d}", 1000), back)])),
        (np.flatnonzero(~large), pa.array(numbers[~large]).cast(pa.string()))])


def _general_many(values: np.ndarray) -> pa.Array:
    whole = (np.abs(values) < 1e11) & (values == np.floor(values))
    rest = [text if len(text := repr(v)) < 12 and not {"e", "n"} & set(text) else general(v) for v in values[~whole].tolist()]
    return placed(len(values), [(np.flatnonzero(whole), pa.array(values[whole].astype(np.int64)).cast(pa.string())),
                                (np.flatnonzero(~whole), pa.array(rest, pa.string()))])


def _pattern_many(tokens: list[Token]) -> Callable[[np.ndarray], Shown] | None:
    """A pattern whose whole digits and decimals stand together, the needed ones next to the point; or nothing but text."""
    tokens = _with_points(tokens)
    if all(k == "text" for k, _ in tokens):
        constant = "".join(t for _, t in tokens)
        return lambda values: (_taken(_table(constant), np.zeros(len(values), np.int64)), np.ones(len(values), bool))
    if any(k not in ("text", "digit", "sign", "exponent") for k, _ in tokens):
        return None
    lay = _layout(tokens)
    blocks = [[tokens[i][1] for i in lay[name]] for name in ("whole", "part", "tail")]
    whole, part, tail = map("".join, blocks)
    together = all(tokens[i][0] == "digit" or i in lay["hidden"]
                   for block in (lay["whole"], lay["part"], lay["tail"]) if block for i in range(block[0], block[-1] + 1))
    exponent = lay["power"] < len(tokens)
    needed, decimals = whole.count("0"), len(part)
    shift = decimals + 2 * lay["percents"] - lay["scale"]
    if not (together and re.fullmatch("#*0*", whole) and whole and re.fullmatch("0*#*", part) and decimals < 12 and re.fullmatch("0*", tail)
            and not (lay["grouped"] and needed > 3) and len([k for k, _ in tokens if k == "exponent"]) == exponent
            and (not exponent or whole == "0" and tail and shift == decimals and not lay["grouped"])):
        return None

    def show(values: np.ndarray) -> Shown:
        digits, fits, power = None, np.ones(len(values), bool), None
        if exponent:
            fits = (values == 0) | (values >= 1e-15) & (values < 1e15)
            known = np.where(fits & (values > 0), values, 1.0)
            power = np.floor(np.log10(known)).astype(np.int64)
            power += known >= _BY_TEN[power + 18]
            power -= known < _BY_TEN[power + 17]
        digits, exact = _half_up(values, shift if power is None else shift - power)
        fits &= exact
        digits = np.where(fits, digits, 0)
        if exponent:
            over = digits >= 10 ** (decimals + 1)
            digits, power = np.where(over, digits // 10, digits), power + over
        front, back = np.divmod(digits, 10**decimals)
        shown = _grouped(front) if lay["grouped"] else pa.array(front).cast(pa.string())
        if needed == 0:
            shown = pc.if_else(pa.array(front == 0), "", shown)
        elif needed > 1:
            shown = pc.utf8_lpad(shown, needed, "0")
        pieces = []
        for i, (kind, text) in enumerate(tokens):
            if kind == "exponent":
                pieces += ["E", _taken(_table("+" if text[1] == "+" else "", "-"), (power < 0).astype(np.int64))]
            elif kind != "digit":
                pieces += [text] * (i not in lay["hidden"])
            elif i == lay["whole"][0]:
                pieces.append(shown)
            elif lay["part"] and i == lay["part"][0]:
                texts = pc.utf8_slice_codeunits(pa.array(back + 10**decimals).cast(pa.string()), 1)
                if "#" in part:
                    texts = pc.utf8_rpad(pc.utf8_rtrim(texts, "0"), part.count("0"), "0")
                pieces.append(texts)
            elif lay["tail"] and i == lay["tail"][0]:
                pieces.append(pc.utf8_lpad(pa.array(np.abs(power)).cast(pa.string()), len(tail), "0"))
        return _joined(pieces), fits

    return show


def _fraction_many(tokens: list[Token]) -> Callable[[np.ndarray], Shown] | None:
    """Whole number and the nearest fraction, found among all fractions of so many digits."""
    fixed, most, mixed = _fraction_kind(tokens)
    if fixed or not mixed or most > 99:
        return None
    near = sorted({Fraction(n, d) for d in range(1, most + 1) for n in range(d + 1)})
    middles = np.array([float((a + b) / 2) for a, b in zip(near, near[1:])])
    names = pa.array(["", *[f"{f.numerator}/{f.denominator}" for f in near[1:-1]], ""], pa.string())

    def show(values: np.ndarray) -> Shown:
        fits = values < 1e9
        values = np.where(fits, values, 0)
        whole = np.floor(values)
        rest = values - whole
        at = np.searchsorted(middles, rest)
        distance = np.minimum(np.abs(rest - middles[np.maximum(at - 1, 0)]), np.abs(rest - middles[np.minimum(at, len(middles) - 1)]))
        fits &= distance > 1e-15 * (4 + values)
        whole = (whole + (at == len(middles))).astype(np.int64)
        none = (at == 0) | (at == len(middles))
        numbers, fractions = pa.array(whole).cast(pa.string()), _taken(names, at)
        between = _taken(_table("", " "), (~none & (whole > 0)).astype(np.int64))
        return _joined([pc.if_else(pa.array(none | (whole > 0)), numbers, ""), between, fractions]), fits

    return show


def _moment_many(tokens: list[Token], from_1904: bool) -> Callable[[np.ndarray], Shown]:
    """Any day but those around 29 February 1900; parts of a date are looked up in tables."""
    minutes, half = _minutes(tokens), any(k == "half" for k, _ in tokens)
    by_calendar = any(k == "date" and t[0].lower() in "ymd" and i not in minutes for i, (k, t) in enumerate(tokens))
    last, epoch = (2_957_002, 24_107) if from_1904 else (2_958_464, 25_569)

    def show(values: np.ndarray) -> Shown:
        fits = (values >= 0) & (values <= last)
        if by_calendar and not from_1904:
            fits &= (values < 59) | (values >= 61)
        values = np.where(fits, values, 0)
        day = np.floor(values)
        exact = (values - day) * _DAY_MS
        ms = np.floor(exact + 0.5)
        fits &= np.abs(exact - np.floor(exact) - 0.5) > 1e-6 + 4e-8 * values
        day, ms = (day + (ms == _DAY_MS)).astype(np.int64), np.where(ms == _DAY_MS, 0, ms).astype(np.int64)
        since_1970 = day - epoch + (day < 60 if not from_1904 else 0)
        at = since_1970.astype("datetime64[D]")
        month = at.astype("datetime64[M]")
        year = at.astype("datetime64[Y]").astype(np.int64) + 1970
        hour = ms // 3_600_000
        numbers = lambda width, most: _counted(f"{{:0{width}d}}", most)
        pieces: list[pa.Array | str] = []
        for i, (kind, text) in enumerate(tokens):
            low, n = text.lower(), len(text)
            if kind == "elapsed":
                elapsed = (day * _DAY_MS + ms) // {"h": 3_600_000, "m": 60_000, "s": 1000}[low[0]]
                pieces.append(pc.utf8_lpad(pa.array(elapsed).cast(pa.string()), n, "0"))
            elif kind == "half":
                pieces.append(_taken(_table(*[name if n == 5 else name[0] for name in ("AM", "PM")]), hour // 12))
            elif kind != "date":
                pieces.append(text)
            elif low[0] == ".":
                pieces.append(pc.utf8_rpad(pc.utf8_slice_codeunits(_taken(_counted(".{:03d}", 1000), ms % 1000), 0, n), n, "0"))
            elif low[0] == "y":
                pieces.append(_taken(numbers(2, 100), year % 100) if n <= 2 else pa.array(year).cast(pa.string()))
            elif low[0] == "d" and n <= 2:
                pieces.append(_taken(numbers(n, 32), (at - month.astype("datetime64[D]")).astype(np.int64) + 1))
            elif low[0] == "d":
                pieces.append(_taken(_table(*[name[: 3 if n == 3 else None] for name in DAYS]), (since_1970 + 3) % 7))
            elif low[0] == "h":
                pieces.append(_taken(numbers(min(n, 2), 24), (hour + 11) % 12 + 1 if half else hour))
            elif low[0] == "s":
                pieces.append(_taken(numbers(min(n, 2), 60), ms // 1000 % 60))
            elif i in minutes:
                pieces.append(_taken(numbers(min(n, 2), 60), ms // 60_000 % 60))
            else:
                names = [{3: name[:3], 5: name[0]}.get(n, name) if n > 2 else str(k).zfill(n) for k, name in enumerate(MONTHS, 1)]
                pieces.append(_taken(_table(*names), month.astype(np.int64) % 12))
        return _joined(pieces), fits

    return show


def _shown_many(tokens: list[Token], from_1904: bool) -> Callable[[np.ndarray], Shown] | None:
    kinds = {k for k, _ in tokens}
    if any(k in ("half", "elapsed") or k == "date" and t[0] != "." for k, t in tokens):
        return _moment_many(tokens, from_1904)
    if "general" in kinds or ("text", "@") in tokens:
        return None
    return _fraction_many(tokens) if ("sign", "/") in tokens and "digit" in kinds else _pattern_many(tokens)


@lru_cache(maxsize=4096)
def compiled_many(code: str, from_1904: bool = False) -> Callable[[np.ndarray], pa.Array]:
    """What cells of this format show for numbers, the same as ``compiled`` gives one by one."""
    if not code or code.strip().lower() in ("general", "@"):
        return _general_many
    one = compiled(code, from_1904)
    parts = [_tokens(s) for s in _sections(code)[:3]]
    conditional = any(condition for _, condition in parts)
    sections = [] if conditional else [(_shown(tokens, from_1904)[1], _shown_many(tokens, from_1904)) for tokens, _ in parts]

    def show(values: np.ndarray) -> pa.Array:
        section = np.zeros(len(values), np.int64)
        if len(sections) > 1:
            section[values < 0] = 1
        if len(sections) > 2:
            section[values == 0] = 2
        pieces, left = [], np.ones(len(values), bool)
        for n, (takes_sign, many) in enumerate(sections):
            at = np.flatnonzero(section == n)
            if not len(at) or many is None:
                continue
            texts, fits = many(values[at] if takes_sign and not n else np.abs(values[at]))
            below = values[at] < 0
            if not n and not takes_sign and below.any():
                minus = pc.and_(pa.array(below), pc.match_substring_regex(texts, "[1-9]"))
                texts = _joined([pc.if_else(minus, "-", ""), texts])
            if not fits.all():
                at, texts = at[fits], texts.filter(pa.array(fits))
            left[at] = False
            pieces.append((at, texts))
        if left.any() or not pieces:
            at = np.flatnonzero(left)
            pieces.append((at, pa.array([one(v) for v in values[at].tolist()], pa.string())))
        return placed(len(values), pieces)

    return show
