"""Column functions that normalise and take apart the dirty text of engineering lists.

All take and return Columns. Nulls give nulls unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_NBSP = "   "


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    out = F.regexp_extract(c, pattern, group)
    return F.when(out != "", out)


def norm_label(c: Column) -> Column:
    """Lower case, runs of other characters than letters and digits to one space; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))


def norm_text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def norm_upper(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def parse_unit_number(c: Column) -> Column:
    """struct(value, text): numbers with an optional kg, mm or m and a decimal point or comma, two places; other text is kept as it is."""
    number = _found(F.trim(c), r"(?i)^\s*([+-]?\d+(?:[.,]\d+)?)\s*(?:kg|mm|m)?\s*$")
    value = F.round(F.regexp_replace(number, ",", ".").try_cast("double"), 2)
    plain = F.trim(c)
    return F.struct(value.alias("value"), F.when(value.isNull() & (plain != ""), plain).alias("text"))


def parse_number(c: Column, mode: str, default: float | None = None) -> Column:
    """A double by one of the conventions of the lists.

    last_sep: the first numeric token, its last point or comma is the decimal mark. comma_thousands: commas group if a point is there
    too, else a comma is the decimal mark. comma_decimal: spaces go, a comma is the mark only without a point, bad text gives default.
    strip_nondigits: all but digits and marks go, a comma is a mark. strip_unit: a trailing kg or mm goes, two places.
    """
    text = F.trim(c)
    if mode == "last_sep":
        token = _found(text, r"([+-]?\d[\d.,]*)", 1)
        token = F.regexp_replace(token, r"[.,]+$", "")
        mark = F.regexp_extract(token, r"([.,])[^.,]*$", 1)
        whole, part = F.regexp_extract(token, r"^(.*?)(?:[.,][^.,]*)?$", 1), F.regexp_extract(token, r"[.,]([^.,]*)$", 1)
        joined = F.when(mark == "", token).otherwise(F.concat(F.regexp_replace(whole, r"[.,]", ""), F.lit("."), part))
        return joined.try_cast("double")
    if mode == "comma_thousands":
        both = text.contains(",") & text.contains(".")
        return F.when(both, F.replace(text, F.lit(","), F.lit(""))).otherwise(F.replace(text, F.lit(","), F.lit("."))).try_cast("double")
    if mode == "comma_decimal":
        tight = F.replace(text, F.lit(" "), F.lit(""))
        marked = F.when(tight.contains(",") & ~tight.contains("."), F.replace(tight, F.lit(","), F.lit("."))).otherwise(tight)
        return F.coalesce(F.when(F.upper(text).isin("", "N/A"), F.lit(None)).otherwise(marked).try_cast("double"), F.lit(default).cast("double"))
    if mode == "strip_nondigits":
        return F.replace(F.regexp_replace(text, r"[^0-9.,-]", ""), F.lit(","), F.lit(".")).try_cast("double")
    if mode == "strip_unit":
        bare = F.regexp_replace(text, r"(?i)\s*(kg|mm)\s*$", "")
        return F.round(F.replace(bare, F.lit(","), F.lit(".")).try_cast("double"), 2)
    raise ValueError(f"unknown mode {mode!r}")


def parse_number_strict(c: Column) -> Column:
    """struct(value, decimals, is_percent) of spreadsheet text that is a number without doubt, else all null.

    Arabic and Persian digits, non-breaking spaces, currency signs, (x) and trailing minus, %, exponents and groups by ', _ or
    spaces are read. One comma or point before exactly three digits is refused as ambiguous, and more than 15 significant digits are.
    """
    text = F.translate(c, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹−", "01234567890123456789-")
    text = F.regexp_replace(F.regexp_replace(text, f"[{_NBSP}]", " "), r"[$€£¥]", "")
    text = F.trim(text)
    minus = text.rlike(r"^\(.*\)$") | text.rlike(r"^-") | text.rlike(r"-$")
    body = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\((.*)\)$", "$1"), r"^[+-]|-$", ""))
    percent = body.rlike(r"%$")
    body = F.trim(F.regexp_replace(body, r"%$", ""))
    exponent = F.regexp_extract(body, r"(?i)e([+-]?\d{1,3})$", 1)
    mantissa = F.regexp_replace(body, r"(?i)e[+-]?\d{1,3}$", "")
    grouped = F.regexp_replace(mantissa, r"(?<=\d)['_ ](?=\d{3}(?:\D|$))", "")
    ambiguous = grouped.rlike(r"^[1-9]\d{0,2}[.,]\d{3}$")
    plain = (
        F.when(grouped.rlike(r"^\d{1,3}(,\d{3}){2,}(\.\d+)?$|^\d{1,3}(,\d{3})+\.\d+$"), F.replace(grouped, F.lit(","), F.lit("")))
        .when(grouped.rlike(r"^\d{1,3}(\.\d{3}){2,}(,\d+)?$|^\d{1,3}(\.\d{3})+,\d+$"), F.replace(F.replace(grouped, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(grouped.rlike(r"^\d*[.,]?\d+$|^\d+[.,]$"), F.replace(grouped, F.lit(","), F.lit(".")))
    )
    significant = F.length(F.regexp_replace(F.replace(plain, F.lit("."), F.lit("")), r"^0+", ""))
    ok = plain.isNotNull() & ~ambiguous & (significant <= 15)
    number = F.concat(plain, F.when(exponent != "", F.concat(F.lit("E"), exponent)).otherwise("")).try_cast("double")
    value = F.when(ok, F.when(minus, -number).otherwise(number) / F.when(percent, 100.0).otherwise(1.0))
    return F.struct(value.alias("value"), F.when(ok, F.length(F.regexp_extract(plain, r"\.(\d+)$", 1))).alias("decimals"), F.when(ok, percent).alias("is_percent"))


def preserve_decimals(c: Column) -> Column:
    """struct(value, decimals) of the number in a text; `DN` and `PN` texts give the number alone."""
    number = F.replace(_found(F.trim(c), r"(?i)^(?:DN|PN)?\s*([+-]?\d+(?:[.,]\d+)?)$"), F.lit(","), F.lit("."))
    return F.struct(number.try_cast("double").alias("value"), F.when(number.isNotNull(), F.length(F.regexp_extract(number, r"\.(\d+)$", 1))).alias("decimals"))


def cell_text(c: Column, kind: str = "string", places: int | None = None, trim: bool = True) -> Column:
    """The text that cells are compared by: null is '', whole numbers have no '.0'."""
    if kind in ("double", "float"):
        rounded = F.round(c, places) if places is not None else c
        out = F.when(rounded == F.floor(rounded), rounded.cast("long").cast("string")).otherwise(rounded.cast("string"))
    else:
        out = F.trim(c.cast("string")) if trim else c.cast("string")
    return F.coalesce(out, F.lit(""))


def norm_code(c: Column) -> Column:
    """Upper case without spaces; a code with /SU gets a leading slash."""
    out = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    return F.when(out.contains("/SU") & ~out.startswith("/"), F.concat(F.lit("/"), out)).otherwise(out)


def norm_article(c: Column) -> Column:
    """Whole numbers without '.0', other text trimmed."""
    text = F.trim(c)
    return F.when(text.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(text, r"\.0*$", "").try_cast("long").cast("string")).otherwise(text)


def norm_cut_length(c: Column) -> Column:
    """A rounded whole number; zero and bad text are null."""
    value = F.round(F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")).cast("long")
    return F.when(value != 0, value)


def strip_cut_length(desc: Column, variant: str = "suffix") -> Column:
    """A description without its cut length. suffix: ' x ddd(d)' goes, what follows stays; first: the first ' x n' goes, 'Fabric Tape' is left alone."""
    if variant == "suffix":
        after = F.trim(F.regexp_extract(desc, r" x \d{3,4}(.*)", 1))
        cut = F.concat(F.regexp_replace(desc, r" x \d{3,4}.*", ""), F.when(after != "", F.concat(F.lit(" "), after)).otherwise(""))
        return F.when(desc.rlike(r" x \d{3,4}"), F.trim(cut)).otherwise(desc)
    bare = F.trim(F.regexp_replace(desc, r"^(.*?) x \d+(?:[.,]\d+)?", "$1"))
    return F.when(desc.contains("Fabric Tape"), desc).otherwise(bare)


def first_int(c: Column) -> Column:
    return _found(c.cast("string"), r"(\d+)").try_cast("long")


def dn_number(c: Column) -> Column:
    """The size of 'DN 25', 'DN50' or '50'."""
    return F.replace(_found(F.trim(c.cast("string")), r"(?i)^(?:DN)?\s*(\d+(?:[.,]\d+)?)"), F.lit(","), F.lit(".")).try_cast("double")


def extract_numeric(c: Column) -> Column:
    """The first number in a text, 0 where there is none."""
    return F.coalesce(F.replace(_found(c.cast("string"), r"(\d+(?:[.,]\d+)?)"), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def max_in_list(c: Column) -> Column:
    """The greatest number of '25, 50, 65'."""
    return F.array_max(F.transform(F.split(c.cast("string"), ","), lambda x: F.trim(x).try_cast("double")))


def natural_key(c: Column) -> Column:
    """A sort token: digit runs padded to six."""
    parts = F.regexp_extract_all(F.upper(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.when(F.length(p) < 6, F.lpad(p, 6, F.lit("0"))).otherwise(p)).otherwise(p)), "")


def _literal(word: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else f"\\{ch}" for ch in word)


def classify_by_rules(c: Column, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> Column:
    """The label of the first rule with a matching prefix, else of the first with a contained keyword, else ''. Case does not count."""
    tests = [("startswith", prefixes, label) for label, prefixes, _ in rules if prefixes] + [("contains", words, label) for label, _, words in rules if words]

    def label_of(low: Column) -> Column:
        out = F.lit("")
        for test, words, label in reversed(tests):
            out = F.when(reduce(or_, (getattr(low, test)(w.lower()) for w in words)), label).otherwise(out)
        return out

    return F.when(c.isNull(), "").otherwise(once(F.lower(c), label_of))


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once for a row, and named in the expression instead of copied."""
    return F.transform(F.array(x), use)[0]


def fluid_phase(c: Column, liquid: Sequence[str], gas: Sequence[str]) -> Column:
    low = F.lower(c)
    has = lambda words: F.coalesce(*[F.when(low.contains(w), True) for w in words], F.lit(False))
    return F.when(c.isNull(), "Unknown").when(has(liquid), "Liquid").otherwise("Gas")


def building_section(area: Column, na_areas: Sequence[str]) -> Column:
    """The first U and two letters of an area; areas of the list are N/A, others UNKNOWN."""
    up = F.upper(F.trim(area))
    return F.coalesce(F.when(up.isin(*na_areas), "N/A"), _found(up, r"(U[A-Z]{2})"), F.lit("UNKNOWN"))


def section_rank(section: Column, order: Sequence[str] = ("UHA", "UMA")) -> Column:
    """A sort token: sections of the list in its order, then all others by name."""
    name = F.upper(F.trim(section))
    rank = F.lit("900")
    for k, own in reversed(list(enumerate(order))):
        rank = F.when(name == own, f"{k:03d}").otherwise(rank)
    return F.concat(rank, F.lit("_"), name)


def bore_class(nb: Column, threshold: float = 40) -> Column:
    return F.when(nb.isNull(), "Unknown").when(nb <= threshold, "SB").otherwise("LB")


#: Code families (fixed patterns).
PIPE_CODE = r"\d[A-Z]{3}\d{2}(?:BR|BQ|RC)\d{3}"
SUPPORT_CODE = r"/?\d[A-Z]{3}\d{2}B[A-Z]\d{3}/SU\w*"
GENERIC_CODE = r"[0-3]\s?[A-Z]{3}\s?\d{2}\s?[A-Z]{2}\s?\d{3}"


def extract_codes(c: Column, pattern: str = GENERIC_CODE) -> Column:
    """The distinct codes of a text without spaces, sorted."""
    found = F.regexp_extract_all(F.upper(c), F.lit(f"({pattern})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s", ""))))


def filename_fields(c: Column) -> Column:
    """struct(code, system, line_no, short, revision) of a drawing's file name; the code is its third field."""
    stem = F.regexp_replace(c, r"\.[A-Za-z0-9]+$", "")
    code = F.try_element_at(F.split(stem, "-"), F.lit(3))
    system = _found(code, r"(\d?[A-Z]{3}\d{2})")
    return F.struct(
        code.alias("code"), system.alias("system"), _found(code, r"[A-Z]{2}(\d{3})").alias("line_no"), _found(system, r"([A-Z]{3})").alias("short"), _found(stem, r"_(\d+\.\d+)").alias("revision")
    )


def parse_list_literal(c: Column) -> Column:
    """The array of "['A','B']"; plain text is an array of one."""
    inner = F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "array<string>")
    return F.when(F.trim(c).rlike(r"^\[.*\]$") & inner.isNotNull(), inner).otherwise(F.array(F.trim(c)))


def parse_xyz(c: Column) -> Column:
    """struct(x, y, z) of 'X 18040mm Y 2.5mm Z -3mm'."""
    one = lambda axis: _found(c, rf"{axis}\s*(-?\d+(?:\.\d+)?)\s*mm").try_cast("double")
    return F.struct(one("X").alias("x"), one("Y").alias("y"), one("Z").alias("z"))


_MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"


def extract_dates(c: Column) -> Column:
    """Distinct dates of a text in the order of their kinds: ISO, d.m.y, month names, then years."""
    patterns = (r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b", r"\b\d{1,2}[./]\d{1,2}[./](?:19|20)\d{2}\b", rf"(?i)\b(?:\d{{1,2}}\s+)?(?:{_MONTHS})\.?\s+(?:19|20)\d{{2}}\b", r"(?<![\d./-])(?:19|20)\d{2}(?![\d./-])")
    return F.array_distinct(F.concat(*(F.regexp_extract_all(c, F.lit(f"({p})"), F.lit(1)) for p in patterns)))


def extract_seal_orders(c: Column, marker: str = "seal") -> Column:
    """array of struct(order_no, multiplier): five-digit order numbers after the marker, with n x before or x n after (else 1)."""
    tail = F.regexp_extract(F.lower(c), rf"{marker}(.*)$", 1)
    found = F.regexp_extract_all(tail, F.lit(r"((?:\d+\s*x\s*)?\b\d{5}\b(?:\s*x\s*\d+\b)?)"), F.lit(1))
    number = lambda x: _found(x, r"\b(\d{5})\b")
    times = lambda x: F.coalesce(_found(x, r"^(\d+)\s*x\s*\d{5}"), _found(x, r"\d{5}\s*x\s*(\d+)$"), F.lit("1")).cast("long")
    return F.transform(found, lambda x: F.struct(number(x).alias("order_no"), times(x).alias("multiplier")))


#: What takes the place of the list of seal orders in a description (fixed wording), and the markers that begin it (fixed values).
SEAL_NOTE = 'Note: The required seal rings are listed separately with "SEAL" type this list.'
SEAL_MARKERS = ("seal ring fkm blue order no.", "seal ring fmk blue order no.")


def rewrite_note(c: Column) -> Column:
    """A description up to the first marker of seal orders, then the note; without a marker as it is."""
    places = [F.instr(F.lower(c), m) for m in SEAL_MARKERS]
    at = F.array_min(F.filter(F.array(*places), lambda p: p > 0))
    head = F.rtrim(c.substr(F.lit(1), at - 1))
    return F.when(at.isNull(), c).when(head == "", SEAL_NOTE).otherwise(F.concat(head, F.lit(f" {SEAL_NOTE}")))


def year_label(c: Column) -> Column:
    """The years of a text (1900 to 2099) in order, joined by '_', or 'no year'."""
    years = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))))
    return F.when(F.size(years) == 0, "no year").otherwise(F.array_join(years, "_"))


#: Tags of replies, forwards and gateways that stand between spaces in a lower-cased subject (fixed values, in the order of removal).
SUBJECT_TAGS = (
    " [external] ", " [ext] ", " re: ", " fw: ", " aw: ", " wg: ", " tr: ", " rv: ", " sv: ", " fs: ", " vs: ", " vl: ", " odp: ", " pd: ", " r: ", " i: ",
)
#: A project prefix 'Project, CODE/CODE/00071: ' with an optional FW: or RE: and [EXT] before it (fixed pattern).
SUBJECT_PREFIX = r"(?i)^(?:(?:FW|RE):\s*(?:\[EXT\]\s*)?)?[^,]+,\s+[^/]+/[^/]+/\d{5}:\s+(.*)$"


def clean_subject(c: Column) -> Column:
    """A subject in lower case without nested project prefixes (ten at most) and without tags."""
    out = c
    for _ in range(10):
        out = F.regexp_replace(out, SUBJECT_PREFIX, "$1")
    out = F.concat(F.lit(" "), F.lower(out))
    for tag in SUBJECT_TAGS:
        out = F.replace(out, F.lit(tag), F.lit(" "))
    return F.trim(out)


def label_fields(c: Column) -> Column:
    """struct(bom_item, size_number): the number after 'BoM Item No:' and the one after L x W x H."""
    return F.struct(_found(c, r"BoM Item No:\s*(\S+)").alias("bom_item"), _found(c, r"\d+\s*x\s*\d+\s*x\s*\d+\s+(\d+(?:[.,]\d+)?)").alias("size_number"))


def ceil_multiple(x: Column, multiple: int) -> Column:
    return F.ceil(x / float(multiple)) * multiple


def nut_washer_round(x: Column) -> Column:
    return F.when(x <= 100, ceil_multiple(x, 10)).when(x <= 500, ceil_multiple(x, 50)).otherwise(ceil_multiple(x, 100))


def paint_cans(m2: Column) -> Column:
    """Cans of 20 litres at a litre for 5 m2; one more if the last can is three quarters full and not full."""
    litres = m2 / 5.0
    cans = F.ceil(litres / 20.0)
    rest = litres - 20.0 * (cans - 1)
    return F.when(m2 <= 0, F.lit(0).cast("long")).otherwise(cans + F.when((rest >= 15.0) & (rest < 20.0), 1).otherwise(0))


def tape_weight_per_m(desc: Column, density: float = 2600.0) -> Column:
    """kg per metre of 'W x T' (mm)."""
    cross_section = F.transform(F.split(F.regexp_extract(F.lower(desc), r"[0-9.]+ *x *[0-9.]+", 0), "x"), lambda side: F.trim(side).try_cast("double") / 1000)
    return F.when(F.size(cross_section) == 2, cross_section[0] * cross_section[1] * density)


def rod_length(desc: Column) -> Column:
    return _found(desc, r"/(\d+)").try_cast("long")


def rod_pieces(desc: Column, total_mm: Column) -> Column:
    """Pieces of a threaded rod in a total length: by '/dddd' of the description, else by metres."""
    return F.ceil(total_mm / F.coalesce(rod_length(desc), F.lit(1000)))


def extra_long(remarks: Column) -> Column:
    """n of 'n off extra-long'."""
    return _found(F.lower(remarks), r"(\d+)\s*off\s*extra-long").try_cast("long")


def forces_by_axis(qx: Column, qy: Column, qz: Column, axis: Column) -> Column:
    """struct(axial, lateral, vertical): absolute loads along the pipe, across it, and down."""
    a = F.upper(F.trim(axis))
    x, y, z = F.abs(qx), F.abs(qy), F.abs(qz)
    return F.struct(
        F.when(a == "X", x).when(a == "Y", y).when(a == "Z", z).alias("axial"),
        F.when(a == "X", y).when(a == "Y", x).when(a == "Z", F.greatest(x, y)).alias("lateral"),
        F.when(a.isin("X", "Y"), z).when(a == "Z", F.lit(0.0)).alias("vertical"),
    )


def uuid5(name: Column, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def viewpoint(x: Column, y: Column, z: Column, code: Column, offset: Sequence[float] = (2.0, -2.0, 2.0)) -> Column:
    """struct of camera and box (metres) of a point in millimetres, folders by code and a stable id."""
    point = [c / 1000.0 for c in (x, y, z)]
    cells = [(p + o).alias(f"camera_{n}") for n, p, o in zip("xyz", point, offset, strict=True)]
    cells += [e.alias(f"box_{side}_{n}") for n, p in zip("xyz", point, strict=True) for side, e in (("min", p - 1.0), ("max", p + 1.0))]
    return F.struct(*cells, F.substring(code, 1, 7).alias("folder"), F.substring(code, 1, 6).alias("subfolder"), uuid5(code).alias("uid"))


def coordinate(row: Column, col: Column) -> Column:
    """A1-style coordinate of one-based row and column (up to three letters)."""
    c = col - 1
    letter = lambda n: F.char((n + 65).cast("int"))
    one, two = letter(c % 26), letter(F.floor((c - 26) / 26) % 26)
    three = letter(F.floor((c - 702) / 676) % 26)
    return F.concat(F.when(col > 702, three).otherwise(""), F.when(col > 26, two).otherwise(""), one, row.cast("string"))
