"""Mixed timestamp formats and time zones, brought to one UTC instant (problem 5).

A text is read by the formats below. A text of three numbers with slashes or hyphens between them can be read in up to three ways: day first,
month first, and, where the last number has two digits, year first. For these, expectation-maximisation runs over the mixture of the formats
that a source (the mail domain) uses: each value gives its likelihood under every parse that is a valid date, the E-step shares it out by the
present mixture, the M-step counts the shares. The posterior chooses the reading, and a value whose best posterior stays under
``sure`` is marked ambiguous. A source that declares its order enters as ``prior`` rows seen of that order; enough values that
only another order can read outweigh it. A source that declares none has no preference; what its data leave open is read month first and
marked. As all values of a source with the same valid parses have the same posterior, EM needs only seven counts a source: the rows are
aggregated once, and each EM step is arithmetic on one row a source.

Defined results: null, empty and unreadable texts, impossible dates and clock times give ``utc`` null and
``status`` ``none``; fractions of a second are dropped; a local time that occurs twice is the earlier one, a
skipped one moves on by the gap; a date alone is its local midnight; two-digit years are 20xx; a null or
unlisted source has zone UTC and no declared order; unknown zone names count as UTC. Other columns pass through;
columns named ``utc`` or ``status`` are replaced, and names of ``sources`` make no clash, as helper columns start with ``_ts_``.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SLASHED = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})(?!\d)"
#: The orders in which such numbers may stand; of equally likely ones the first is taken.
ORDERS = ("mdy", "dmy", "ymd")
#: Rows that a source counts as seen of each order before any is read.
BEFORE = {"mdy": 1.0, "dmy": 1.0, "ymd": 0.1}

# Month names by their first letters, in English, German, French, Spanish and Norwegian.
MONTHS = {
    "jan": 1, "janvier": 1, "enero": 1, "ene": 1, "jän": 1,
    "feb": 2, "fev": 2, "fév": 2, "mar": 3, "mär": 3, "mrz": 3, "mars": 3, "marzo": 3,
    "apr": 4, "avr": 4, "abr": 4, "may": 5, "mai": 5, "mayo": 5,
    "jun": 6, "juin": 6, "jul": 7, "juil": 7, "aug": 8, "aoû": 8, "aou": 8, "ago": 8,
    "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12, "déc": 12, "dic": 12, "des": 12,
}
# Minutes east of UTC of zone names; CST and the like are North American, BST is British.
ZONES = {
    "utc": 0, "gmt": 0, "z": 0, "ut": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "ist": 330, "gst": 240,
    "aest": 600, "aedt": 660,
}

_CLOCK = r"(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,]\d+)?)?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?"
_ZONE = r"(?:\s*\(?(?P<z>(?:UTC|GMT)?\s*[+-]\d{1,2}:?\d{2}|(?:UTC|GMT)[+-]\d{1,2}|[A-Za-z]{1,4})\)?(?:\s*\([A-Za-z ]+\))?)?"
_TIME = rf"(?:(?:[,\s]+|\s*T)(?:at\s+|kl\.?\s*|um\s+|à\s+|a las\s+)?{_CLOCK}{_ZONE})?"
_WORD = r"[^\W\d_]+"
_FORMS = [
    re.compile(r"^(?P<epoch>\d{10}|\d{13})$"),
    re.compile(r"^(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})T?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})(?P<z>Z|[+-]\d{4})?$"),
    re.compile(rf"^(?P<y>\d{{4}})[-/.](?P<m>\d{{1,2}})[-/.](?P<d>\d{{1,2}}){_TIME}$"),
    re.compile(rf"^(?P<d>\d{{1,2}})\.\s?(?P<m>\d{{1,2}})\.\s?(?P<y>\d{{4}}|\d{{2}}){_TIME}$"),
    re.compile(rf"^(?P<a>\d{{1,2}})[/-](?P<b>\d{{1,2}})[/-](?P<c>\d{{4}}|\d{{2}}){_TIME}$"),
    re.compile(rf"^(?:{_WORD}\.?,?\s+)?(?P<d>\d{{1,2}})(?:\.|er|st|nd|rd|th)?[\s-]+(?:de\s+)?(?P<mn>{_WORD})\.?,?[\s-]+(?:de\s+)?(?P<y>\d{{4}}|\d{{2}}){_TIME}$"),
    re.compile(rf"^(?:{_WORD}\.?,?\s+)?(?P<mn>{_WORD})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TIME}$"),
    re.compile(rf"^{_WORD}\.?,?\s+(?P<mn>{_WORD})\.?\s+(?P<d>\d{{1,2}})\s+{_CLOCK}\s+(?P<y>\d{{4}})(?:\s+(?P<z>[+-]\d{{4}}|[A-Z]{{2,4}}))?$"),
]


@lru_cache(maxsize=512)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _month(word: str) -> int | None:
    w = word.lower()
    for n in (len(w), 4, 3):
        if w[:n] in MONTHS:
            return MONTHS[w[:n]]
    return None


def _offset(text: str) -> int | None:
    """Minutes east of UTC, or None for a name that is no zone."""
    t = text.strip().lower()
    if t in ZONES:
        return ZONES[t]
    m = re.fullmatch(r"(?:utc|gmt)?\s*([+-])(\d{1,2}?):?(\d{2})?", t)
    if not m:
        return None
    minutes = int(m[2]) * 60 + int(m[3] or 0)
    return minutes if m[1] == "+" else -minutes


def read(text: str | None, zone: str | None = None, order: str | None = None) -> str | None:
    """The UTC instant of ``text`` as ``yyyy-MM-ddTHH:mm:ssZ``, or None where it holds no date."""
    if not text:
        return None
    t = re.sub(r"\s+", " ", text).strip()
    for form in _FORMS:
        m = form.match(t)
        if m:
            break
    else:
        return None
    g = m.groupdict()
    try:
        if g.get("epoch"):
            seconds = int(g["epoch"]) // (1000 if len(g["epoch"]) == 13 else 1)
            return (datetime(1970, 1, 1) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")
        if g.get("a"):
            of = dict(zip(order or "mdy", (g["a"], g["b"], g["c"]), strict=True))
            day, month, g["y"] = int(of["d"]), int(of["m"]), of["y"]
        else:
            day = int(g["d"])
            month = _month(g["mn"]) if g.get("mn") else int(g["m"])
            if month is None:
                return None
        year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
        hour, minute, second = (int(g.get(k) or 0) for k in ("h", "mi", "s"))
        half = (g.get("ap") or "").lower().replace(".", "")
        if half:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if half == "pm" else 0)
        local = datetime(year, month, day, hour, minute, min(second, 59))
        if g.get("z"):
            minutes = _offset(g["z"])
            if minutes is None:
                return None
            utc = local - timedelta(minutes=minutes)
        else:
            tz = _zone(zone) if zone else None
            # fold=0 takes the first of two equal local times, and the offset from before a gap.
            utc = local.replace(tzinfo=tz).astimezone(timezone.utc).replace(tzinfo=None) if tz else local
        return f"{utc.year:04d}-{utc.month:02d}-{utc.day:02d}T{utc.hour:02d}:{utc.minute:02d}:{utc.second:02d}Z"
    except (ValueError, OverflowError):
        return None


@F.pandas_udf(StringType())
def _read_all(text: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
    seen: dict = {}
    out = []
    for key in zip(text, zone, order, strict=True):
        if key not in seen:
            seen[key] = read(*key)
        out.append(seen[key])
    return pd.Series(out, dtype=object)


def mail_domain(address: Column) -> Column:
    """The lower-cased domain of the last address in a text, or null."""
    return F.nullif(F.lower(F.regexp_extract(address, r"@([^@\s<>;,\"']+)[^@]*$", 1)), F.lit(""))


def _valid_orders(text: Column) -> Column:
    """The orders, as m, d and y in one text, that make a date of numbers with slashes; null for other texts, empty where none does."""
    a, b, c = (F.try_to_number(F.nullif(F.regexp_extract(text, SLASHED, k), F.lit("")), F.lit("9999")).cast("int") for k in (1, 2, 3))
    short = F.char_length(F.regexp_extract(text, SLASHED, 3)) == 2
    year = F.when(short, c + 2000).otherwise(c)
    date = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).isNotNull()
    fits = F.concat(F.when(date(year, a, b), "m").otherwise(""), F.when(date(year, b, a), "d").otherwise(""), F.when(short & date(a + 2000, b, c), "y").otherwise(""))
    return F.when(F.regexp_like(text, F.lit(SLASHED)), fits)


def order_posteriors(values: DataFrame, prior: float = 20.0, steps: int = 25) -> DataFrame:
    """One row a source: ``_ts_source`` and ``_ts_mix``, the share of each order (m, d, y) in the mixture of its values.

    ``values`` has ``_ts_source``, ``_ts_fits`` (the orders that are valid) and ``_ts_order`` (declared). The rows are aggregated to seven
    counts a source before the shuffle, so a source that holds most rows costs no more than another.
    """
    n = lambda k: F.sum(F.when(F.col("_ts_fits") == k, 1.0).otherwise(0.0)).alias(f"_{k}")
    masks = ("m", "d", "y", "md", "my", "dy", "mdy")
    counts = values.filter("_ts_fits <> ''").groupBy("_ts_source").agg(*map(n, masks), F.max("_ts_order").alias("_o"))
    before = {o[0]: F.lit(BEFORE[o]) + F.when(F.col("_o") == o, prior).otherwise(0.0) for o in ORDERS}
    whole = sum(before.values(), sum((F.col(f"_{k}") for k in masks), F.lit(0.0)))

    def step(mix: Column, _: Column) -> Column:
        # E: a value of mask k gives order o the share mix[o] / (sum of mix over k). M: shares and prior rows over all rows.
        share = lambda o: sum((F.col(f"_{k}") * mix[o] / sum((mix[x] for x in k[1:]), mix[k[0]]) for k in masks if o in k), before[o])
        return F.struct(*[(share(o) / whole).alias(o) for o in "mdy"])

    total = sum(before.values(), F.lit(0.0))
    start = F.struct(*[(before[o] / total).alias(o) for o in "mdy"])
    return counts.select("_ts_source", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("_ts_mix"))


def normalise(df: DataFrame, text: str, address: str, sources: DataFrame, prior: float = 20.0, sure: float = 0.9) -> DataFrame:
    """``df`` with ``utc`` and ``status`` (``read``, ``ambiguous`` or ``none``) for its column ``text``.

    ``sources`` (mail_domain, zone_name, date_order) is one row a mail domain, joined by Spark's own choice
    of strategy. Ambiguous values still get the likelier reading.
    """
    src = sources.groupBy(F.lower("mail_domain").alias("_ts_source")).agg(
        F.min_by("zone_name", "zone_name").alias("_ts_zone"), F.min("date_order").alias("_ts_order")
    )
    rows = df.withColumns({"_ts_source": mail_domain(F.col(address)), "_ts_fits": _valid_orders(F.col(text))}).join(src, "_ts_source", "left")
    post = order_posteriors(rows, prior)
    rows = rows.join(post.withColumnRenamed("_ts_source", "_ts_key"), F.col("_ts_source").eqNullSafe(F.col("_ts_key")), "left")
    weight = {o: F.when(F.contains("_ts_fits", F.lit(o[0])), F.coalesce(F.col("_ts_mix")[o[0]], F.lit(0.0))).otherwise(0.0) for o in ORDERS}
    best, total = F.greatest(*weight.values()), sum(weight.values(), F.lit(0.0))
    order = F.when(F.col("_ts_fits") != "", F.coalesce(*[F.when(F.round(w, 9) == F.round(best, 9), o) for o, w in weight.items()]))
    out = rows.withColumn("utc", _read_all(F.col(text), F.coalesce("_ts_zone", F.lit("UTC")), order))
    vague = (F.char_length("_ts_fits") > 1) & (best < sure * total)
    status = F.when(F.col("utc").isNull(), "none").when(F.coalesce(vague, F.lit(False)), "ambiguous").otherwise("read")
    return out.withColumn("status", status).select(*[F.col(f"`{c}`") for c in df.columns if c not in ("utc", "status")], "utc", "status")


def found(email_metadata: DataFrame, thread_messages: DataFrame, mail_domains: DataFrame) -> DataFrame:
    """p5_found: field, doc_id, message_index, utc of every readable value; repeated rows count once."""
    mails = email_metadata.select(F.lit("email_date").alias("field"), "doc_id", F.lit(-1).cast("long").alias("message_index"), F.col("from_addr").alias("who"), F.col("date").alias("value"))
    t = thread_messages.select("doc_id", F.col("message_index").cast("long").alias("message_index"), F.col("author").alias("who"), F.expr("stack(2, 'date', date, 'date_str', date_str) as (field, value)"))
    rows = mails.unionByName(t).distinct()
    out = normalise(rows, "value", "who", mail_domains)
    return out.filter("utc is not null").select("field", "doc_id", "message_index", "utc").distinct()
