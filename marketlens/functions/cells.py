"""Cell parsing, status folding and display formats, as column expressions.

A parsed cell has three states: a value, blank, or refused with a reason.  Refused cells never become numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.vocab import BUCKETS, CAUTION, DAYS_MAX, KICKOUT, PRICE_MAX, PRICE_MIN, STATUS_BUCKET

#: White space that trimming removes: ASCII, no-break space, byte-order mark and the Unicode spaces.
_SPACE = r"[\s\x{0B}\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_AMOUNT = r"\A\$?" + _SPACE + r"?([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.([0-9]{1,2}))?\z"
DASH = "—"


def once(value: Column, then) -> Column:
    """``then(value)``, with ``value`` evaluated once and not wherever ``then`` uses it (through a one-element array)."""
    return F.transform(F.array(value), then)[0]


def trimmed(c: Column) -> Column:
    """Without leading and trailing white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"\A{_SPACE}+|{_SPACE}+\z", "")


def label_key(c: Column) -> Column:
    """Case, blanks and punctuation do not distinguish labels."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def _cell(value: Column, blank: Column, why: Column) -> Column:
    def cell(x: Column) -> Column:
        state = F.when(x["blank"], "blank").when(x["why"].isNotNull(), "error").otherwise("value")
        return F.struct(F.when(~x["blank"] & x["why"].isNull(), x["value"]).alias("value"), state.alias("state"), F.when(~x["blank"], x["why"]).alias("why"))

    return once(F.struct(value.alias("value"), blank.alias("blank"), why.alias("why")), cell)


def money(c: Column, concession: bool = False) -> Column:
    """An amount in dollars: "$1,234.50", "1234".  Grouping must be exact.

    A price is rounded to whole dollars, zero is blank, and bounds apply; a concession keeps its cents and has
    an upper bound only.
    """

    def of(t: Column) -> Column:
        whole = F.regexp_replace(F.regexp_extract(t, _AMOUNT, 1), ",", "")
        cents = F.rpad(F.regexp_extract(t, _AMOUNT, 2), 2, "0")
        # 26 digits before the point hold every amount that the bounds could accept; longer ones are out of range anyway.
        amount = F.try_to_number(F.concat(whole, F.lit("."), cents), F.lit("9" * 26 + ".99"))
        return once(F.when(F.length(whole) <= 26, amount), lambda v: judged(t, v))

    def judged(t: Column, amount: Column) -> Column:
        is_amount = t.rlike(_AMOUNT)
        if concession:
            out_of_range = F.coalesce(amount > PRICE_MAX, F.lit(True))
            why = F.when(~is_amount, "not an amount").when(out_of_range, "out of range")
            return _cell(amount.cast("decimal(12,2)"), t == "", why)
        rounded = F.round(amount, 0).cast("decimal(28,0)")
        zero = is_amount & F.coalesce(rounded == 0, F.lit(False))
        out_of_range = F.coalesce((rounded < PRICE_MIN) | (rounded > PRICE_MAX), F.lit(True))
        why = F.when(~is_amount, "not an amount").when(out_of_range, "out of range")
        return _cell(F.when(~out_of_range, rounded).cast("bigint"), (t == "") | zero, why)

    return once(trimmed(c), of)


def days(c: Column) -> Column:
    """Whole days, zero included, grouping allowed."""

    def of(t: Column) -> Column:
        digits = F.regexp_replace(t, ",", "")
        fits = t.rlike(r"\A(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\z")
        value = F.when(fits & (F.length(F.regexp_replace(digits, r"\A0+", "")) <= 4), digits.try_cast("int"))
        why = lambda v: F.when(~fits, "not a whole number of days").when(F.coalesce(v > DAYS_MAX, F.lit(True)), "out of range")
        return once(value, lambda v: _cell(v, t == "", why(v)))

    return once(trimmed(c), of)


def typed_money(c: Column, concession: bool = False) -> Column:
    """An amount typed by hand: blanks, "$" and commas are dropped wherever they stand."""
    least = 0 if concession else PRICE_MIN

    def of(t: Column, bare: Column) -> Column:
        fits = bare.rlike(r"\A[0-9]+(?:\.[0-9]+)?\z")
        amount = F.when(fits & (F.length(F.regexp_extract(bare, r"\A0*([0-9]*)", 1)) <= 12), F.round(F.substring(bare, 1, 40).try_cast("decimal(38,10)"), 2 if concession else 0))
        why = lambda v: F.when(~fits, "not an amount").when(F.coalesce((v < least) | (v > PRICE_MAX), F.lit(True)), "out of range")
        return once(amount, lambda v: once(why(v), lambda w: _cell(F.when(w.isNull(), v).cast("decimal(12,2)" if concession else "bigint"), t == "", w)))

    return once(trimmed(c), lambda t: once(F.regexp_replace(t, rf"{_SPACE}|[$,]", ""), lambda bare: of(t, bare)))


def typed_days(c: Column) -> Column:
    """Days typed by hand: blanks and commas are dropped wherever they stand."""
    bare = lambda t: F.when(t == "", "").otherwise(F.coalesce(F.nullif(F.regexp_replace(t, rf"{_SPACE}|,", ""), F.lit("")), F.lit("?")))
    return days(once(trimmed(c), bare))


def status_text(c: Column) -> Column:
    """A status cell as carried: the text itself, hours of a kick-out code dropped, null if blank."""
    t = trimmed(c)
    base = F.regexp_extract(F.upper(t), rf"\A({'|'.join(KICKOUT)})[0-9]+\z", 1)
    return F.when(t != "", F.when(base != "", base).otherwise(t))


def status_code(c: Column) -> Column:
    """The vocabulary code of a status text; null if it has none."""

    def code(s: Column) -> Column:
        known = lambda x: x.isin(*STATUS_BUCKET)
        base = F.regexp_extract(s, rf"\A({'|'.join(KICKOUT)})[0-9]+\z", 1)
        private = F.regexp_extract(s, r"(?s)\APRIV-(.+)\z", 1)
        return F.when(known(s), s).when(base != "", base).when(private != "", F.when(known(private), private).otherwise("PRIV"))

    return once(F.upper(trimmed(c)), code)


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c) if table else F.lit(None).cast("string")


def bucket(status: Column, overrides: dict[str, str] | None = None) -> Column:
    """The bucket of a status under the default mapping and a user's overrides; unknown ones are unclassified."""
    known = {c: b for c, b in (STATUS_BUCKET | (overrides or {})).items() if b in BUCKETS}
    return F.coalesce(_lookup(status_code(status), known), F.lit("unclassified"))


def caution(code: Column) -> Column:
    return _lookup(code, CAUTION)


def price_of(bucket_: Column, list_price: Column, sold_price: Column) -> Column:
    """What a row adds to its bucket's prices: sold price if closed, list price if active or pending, never the other."""
    want = F.when(bucket_ == "closed", sold_price).when(bucket_.isin("active", "pending"), list_price)
    return F.when(want > 0, want)


def net_ratio(sold: Column, concessions: Column, orig: Column) -> Column:
    """(sold - concessions) / original list price, null unless every part is positive."""
    net = sold.cast("decimal(18,2)") - F.greatest(F.coalesce(concessions, F.lit(0)), F.lit(0)).cast("decimal(18,2)")
    return F.when((sold > 0) & (orig > 0) & (net > 0), net.cast("double") / orig.cast("double"))


def dollars(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(F.round(c).cast("bigint"), 0)), F.lit(DASH))


def day_count(c: Column) -> Column:
    return F.coalesce(F.format_number(F.round(c).cast("bigint"), 0), F.lit(DASH))


def percent(c: Column) -> Column:
    """Three decimals of the binary value."""
    return F.coalesce(F.concat(F.call_function("format_number", c * 100, F.lit("0.000")), F.lit("%")), F.lit(DASH))


def amount_text(c: Column) -> Column:
    return F.coalesce(F.call_function("format_number", c, F.lit("#,##0.##")), F.lit(""))


def line_list(lines: Column, most: int = 8) -> Column:
    """ "line 4", "lines 4, 9 and 12", and past ``most`` how many more."""
    n = F.size(lines)
    shown = F.transform(F.slice(lines, 1, most), lambda x: x.cast("string"))
    more = n - F.size(shown)
    several = F.when(more > 0, F.array_join(shown, ", ")).otherwise(F.concat(F.array_join(F.slice(shown, 1, F.greatest(F.size(shown) - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(shown, -1)))
    words = F.when(F.size(shown) == 1, F.concat(F.lit("line "), shown[0])).otherwise(F.concat(F.lit("lines "), several))
    return F.when(n > 0, F.concat(words, F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise("")))
