"""Format-preserving pseudonyms for personal data, with column expressions only.

A text is cut at what looks like personal data. Each find is validated (Luhn, calendar, octets, number ranges); what is
not valid stays. A valid number or date is read as an index into its format's own range and permuted there by a keyed
Feistel network (cycle walking keeps it inside), then printed in the same format: the permutation is one-to-one, so equal
values stay equal across documents and different ones stay different. E-mail names and secrets, which have no number
range, are replaced by keyed digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.exprs import let

ROUNDS = 8
WALKS = 24

#: Fixed: the patterns of the kinds. Look-arounds keep them off longer words and numbers.
_PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r'(?<=["\x27])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?=["\x27])|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])',
    "date": r"(?<![\d.\p{L}/-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d[/.]\d\d[/.](?:19|20)\d\d)(?![\d\p{L}/-])",
    "phone": r"(?<![\d\p{L}+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\d\p{L}])",
    "ssn": r"(?<![\d\p{L}-])\d{3}-\d\d-\d{4}(?![\d\p{L}-])",
    "card": r"(?<![\d\p{L}])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?![\d\p{L}])",
    "ip": r"(?<![\d\p{L}.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d\p{L}]|\.\d)",
}
ANY = "|".join(f"(?:{p})" for p in _PATTERNS.values())


def _keyed(key: str, *parts: Column) -> Column:
    """A number from 0 below 2^60 that depends on the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def permute(value: Column, size: Column, key: str, tweak: Column) -> Column:
    """A keyed one-to-one map of 0..size-1 onto itself: Feistel rounds on a grid just larger, walked until inside.

    The grid has under sqrt(size) + 1 places more than size, so a walk passes them all within WALKS steps for sizes under
    500, and for larger ones is still outside with probability under size^(-WALKS / 2); its value then stays as it is.
    """

    def turned(i: int, a: Column, b: Column):
        def left(s: Column) -> Column:
            return F.struct(F.pmod(s["l"] + F.pmod(_keyed(key, tweak, F.lit(i), s["r"]), a), a).alias("l"), s["r"].alias("r"))

        def right(s: Column) -> Column:
            return F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_keyed(key, tweak, F.lit(i), s["l"]), b), b).alias("r"))

        return right if i % 2 else left

    def on_grid(b: Column) -> Column:
        div = lambda x, y: F.call_function("div", x, y)

        def with_rows(a: Column) -> Column:
            def once(x: Column) -> Column:
                state = F.struct(div(x, b).alias("l"), F.pmod(x, b).alias("r"))
                for i in range(ROUNDS):
                    state = let(state, turned(i, a, b))
                return let(state, lambda s: s["l"] * b + s["r"])

            walked = F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), value, lambda x, i: F.when((i > 0) & (x < size), x).otherwise(once(x)))
            return let(walked, lambda x: F.when(x < size, x).otherwise(value))

        return let(div(size + b - 1, b), with_rows)

    return let(F.ceil(F.sqrt(size.cast("double"))).cast("long"), on_grid)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _fill(m: Column, digits: Column) -> Column:
    """m with its digits replaced in turn by those given, all else as it is."""
    return F.array_join(
        F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(digits, F.length(_digits(F.substring(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""
    )


def _weighted(digits: Column, odd: int) -> Column:
    """Luhn sum; the digits whose distance from the end is even (odd=1: odd) count double."""
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(F.coalesce(F.expr("0") + F.when(c != "", c.cast("int")), F.lit(0)), lambda d: F.when(i % 2 == odd, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def _padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _card(d: Column) -> Column:
    """All digits but the last, which is made anew."""
    return F.when(F.pmod(_weighted(d, 1), F.lit(10)) == 0, F.substring(d, F.lit(1), F.length(d) - 1).cast("long"))


def _phone_head(m: Column) -> Column:
    return F.regexp_extract(m, r"^\+\d{1,3}?(?=[ .(-])|^\+\d", 0)


def _phone_tail(m: Column) -> Column:
    return F.substring(m, F.length(_phone_head(m)) + 1, F.length(m))


def _ssn(m: Column) -> Column:
    area, group, serial = (F.regexp_extract(m, r"(\d+)-(\d+)-(\d+)", i).cast("int") for i in (1, 2, 3))
    ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    return F.when(ok, ((area - 1 - F.when(area > 666, 1).otherwise(0)).cast("long") * 99 + group - 1) * 9999 + serial - 1)


def _ssn_text(x: Column) -> Column:
    top = F.floor(x / F.lit(99 * 9999))
    return F.concat(_padded(top + F.when(top >= 665, 2).otherwise(1), 3), F.lit("-"), _padded(F.floor(x / F.lit(9999)) % 99 + 1, 2), F.lit("-"), _padded(x % 9999 + 1, 4))


def _ip(m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    return F.when(F.forall(parts, lambda p: p < 256), F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def _ip_text(x: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(x, s) % 256).cast("string") for s in (24, 16, 8, 0)])


def _date(m: Column) -> Column:
    iso = m.rlike(r"^\d{4}-")
    year = F.when(iso, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4)).cast("int")
    month = F.when(iso, F.substring(m, 6, 2)).otherwise(F.substring(m, 4, 2)).cast("int")
    day = F.when(iso, F.substring(m, 9, 2)).otherwise(F.substring(m, 1, 2)).cast("int")
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = month.between(1, 12) & (day >= 1) & (day <= last)
    return F.when(ok, F.datediff(F.make_date(year, month, day), F.lit("1900-01-01").cast("date")).cast("long"))


def _date_text(m: Column, x: Column) -> Column:
    d = F.date_add(F.lit("1900-01-01").cast("date"), x.cast("int"))
    sep = F.substring(m, 3, 1)
    other = F.concat_ws("", F.date_format(d, "dd"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "yyyy"))
    return F.when(m.rlike(r"^\d{4}-"), F.date_format(d, "yyyy-MM-dd")).otherwise(other)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("user."), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@mail.example"))


def _secret(m: Column, key: str) -> Column:
    """A digest as long as the secret, in its case, behind the prefix that tells its kind."""
    prefix = F.regexp_extract(m, "^(?:AKIA|gh[pousr]_|sk-)", 0)
    name = F.concat_ws("|", F.lit(key), F.lit("secret"), m)
    digest = F.substring(F.concat(*[F.sha2(F.concat_ws("|", name, F.lit(i)), 256) for i in range(2)]), F.lit(1), F.length(m) - F.length(prefix))
    return F.concat(prefix, F.when(m.rlike("^[0-9A-Z]+$"), F.upper(digest)).otherwise(digest))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one find; a find that does not hold up to validation is returned as it is."""
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    kind = F.when(m.contains("@"), "email").when(m.startswith("+"), "phone").when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip").when(m.rlike(r"^\d{3}-\d\d-\d{4}$"), "ssn")
    kind = kind.when(m.rlike(r"^(?:\d{4}-\d\d-\d\d|\d\d[/.]\d\d[/.]\d{4})$"), "date").when(m.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card").otherwise("secret")

    def of_kind(k: Column) -> Column:
        digits = F.when(k == "phone", _digits(_phone_tail(m))).otherwise(_digits(m))

        def of_digits(d: Column) -> Column:
            index = F.when(k == "ip", _ip(m)).when(k == "ssn", _ssn(m)).when(k == "date", _date(m)).when(k == "phone", d.cast("long")).when(k == "card", _card(d))
            size = F.when(k == "ip", F.lit(1 << 32)).when(k == "ssn", F.lit(898 * 99 * 9999)).when(k == "date", F.lit(73049)).when(k == "phone", power(F.length(d))).otherwise(power(F.length(d) - 1))

            def printed(x: Column) -> Column:
                body = _padded(x, F.length(d) - 1)
                card = let(body, lambda b: let(F.concat(b, F.pmod(-_weighted(b, 0), F.lit(10)).cast("string")), lambda c: _fill(m, c)))
                phone = F.concat(_phone_head(m), let(_padded(x, F.length(d)), lambda c: _fill(_phone_tail(m), c)))
                return F.when(k == "ip", _ip_text(x)).when(k == "ssn", _ssn_text(x)).when(k == "date", _date_text(m, x)).when(k == "phone", phone).otherwise(card)

            numbers = let(index, lambda v: F.when(v.isNull(), m).otherwise(let(let(size, lambda n: permute(v, n, key, F.concat(k, F.length(d).cast("string")))), printed)))
            return F.when(k == "email", _email(m, key)).when(k == "secret", _secret(m, key)).otherwise(numbers)

        return let(digits, of_digits)

    return let(kind, of_kind)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_replaced") -> DataFrame:
    """docs with text_col's personal data replaced, and how many finds changed in count_col, if that is named.

    key: whoever has it can undo the permutations; the same key gives the same pseudonyms in every run.

    Null texts stay null (0 finds), texts without finds stay as they are; all other columns and all rows are kept. A
    column of the frame that is named like count_col is replaced.
    """
    text = F.col(text_col)

    def replaced(found: Column) -> Column:
        new = F.transform(found, lambda m: pseudonym(m, key))
        gaps = F.split(text, ANY, -1)

        def joined(n: Column) -> Column:
            put = F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(n, i), F.lit(""))))), "")
            changed = F.aggregate(F.zip_with(found, n, lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
            return F.struct(put.alias("text"), changed.cast("long").alias("n"))

        return F.when(F.size(found) > 0, let(new, joined)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))

    done = "__pseudonyms"
    out = docs.withColumn(done, F.when(text.isNotNull(), let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), replaced)))
    out = out.withColumn(text_col, F.col(f"{done}.text"))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.col(f"{done}.n"), F.lit(0).cast("long")))
    return out.drop(done)
