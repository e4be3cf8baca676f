"""Identifiers and statement fields as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKENS = ("", "NULL", "NaN")
#: Ordered keywords of the transaction types; the first type with a hit wins.
TRANSACTION_KEYWORDS = {
    "UPI": ("upi",),
    "NEFT": ("neft", "national electronic"),
    "IMPS": ("imps", "immediate payment"),
    "RTGS": ("rtgs", "real time gross"),
    "ATM": ("atm", "cash withdrawal"),
    "POS": ("pos", "point of sale", "card swiped", "purchase"),
    "CASH": ("cash",),
    "CHEQUE": ("chq", "cheque", "chk", "check no"),
}
#: Date formats of statements, tried in this order.
DATE_FORMATS = ("d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d/M/yy", "d MMM yyyy", "d-MMM-yyyy")
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """Null for the null tokens."""
    c = F.trim(_col(c).cast("string"))
    return F.when(~c.isin(*NULL_TOKENS), c)


def norm_phone(c: Column | str) -> Column:
    """Exactly ten digits; a trailing .0 of a number read as float is dropped."""
    v = F.regexp_replace(known(c), r"\.0$", "")
    return F.when(v.rlike("^[0-9]{10}$"), v)


def norm_imei(c: Column | str) -> Column:
    """At least 14 digits; float text, also with an exponent, is written out."""
    v = known(c)
    written = F.when(v.rlike("[eE]"), v.try_cast("decimal(20,0)").cast("string")).otherwise(F.regexp_extract(v, r"^([^.]*)", 1))
    return F.when(written.rlike("^[0-9]{14,}$"), written)


def norm_ip(c: Column | str) -> Column:
    v = known(c)
    return F.when(v.contains("."), v)


def norm_text(c: Column | str) -> Column:
    """Names, cities and networks: trimmed, lower case."""
    return F.lower(known(c))


def is_private_ip(c: Column | str) -> Column:
    return _col(c).rlike(r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)")


def upi_phone_any(c: Column | str) -> Column:
    """The first ten digits in a row anywhere."""
    return F.nullif(F.regexp_extract(_col(c), "([0-9]{10})", 1), F.lit(""))


def upi_phone_handle(c: Column | str) -> Column:
    """Ten digits that are all that stands before the @."""
    return F.nullif(F.regexp_extract(_col(c), "^([0-9]{10})@", 1), F.lit(""))


def extract_upi(narration: Column | str, ascii_only: bool = False) -> Column:
    """The first handle, lower case; greedy over - and . as narrations are written. ``ascii_only``: of A-Z, a-z, 0-9, _, . and - alone."""
    pattern = r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+" if ascii_only else r"(?U)[\w.-]+@[\w.-]+"
    return F.lower(F.nullif(F.regexp_extract(_col(narration), pattern, 0), F.lit("")))


def transaction_type(narration: Column | str, word_boundary: bool = False) -> Column:
    """By keyword, in order; substrings count unless ``word_boundary``."""
    n = F.lower(_col(narration))
    found = None
    for kind, words in TRANSACTION_KEYWORDS.items():
        hit = n.rlike(r"\b(" + "|".join(words) + r")\b") if word_boundary else n.rlike("|".join(words))
        found = F.when(hit, kind) if found is None else found.when(hit, kind)
    return found.otherwise("OTHER")


def parse_amount(c: Column | str) -> Column:
    """Commas and the rupee sign dropped, parentheses as minus; what doesn't parse is 0."""
    v = F.regexp_replace(F.trim(_col(c)), "[,₹ ]", "")
    v = F.regexp_replace(v, r"^\((.*)\)$", "-$1")
    return F.coalesce(v.try_cast("double"), F.lit(0.0))


def signed_amount(withdrawal: Column | str, deposit: Column | str) -> Column:
    """Minus the withdrawal if positive, else the deposit if positive, else 0."""
    w, d = _col(withdrawal), _col(deposit)
    return F.when(w > 0, -w).when(d > 0, d).otherwise(0.0)


def parse_date(c: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits, as a time without zone; null if none does."""
    v = F.trim(_col(c))
    return F.coalesce(*(F.try_to_timestamp(v, F.lit(f)) for f in formats)).cast("timestamp_ntz")


def parse_time(c: Column | str) -> Column:
    v = F.regexp_replace(known(c), r"(Z|[+-][0-9]{2}:[0-9]{2})$", "")
    return parse_date(v, TIME_FORMATS)


def is_injected(c: Column | str) -> Column:
    return F.coalesce(_col(c).startswith("INJ_"), F.lit(False))


def canonical_channel(c: Column | str) -> Column:
    return F.when(_col(c) == "Internet_Banking", "Net_Banking").otherwise(_col(c))


#: Channels by what the mode of a transfer holds (or, for the codes, is), in order.
CHANNELS = (("Mobile_App", ("UPI",)), ("ATM", ("ATM", "WITHDRAWAL")), ("Branch", ("CASH DEPOSIT", "BRANCH")), ("Net_Banking", ("=NEFT", "=RTGS")), (None, ("IMPS",)), ("POS", ("POS", "CARD")))
#: Shares of the channels, in per cent, where the mode leaves it open.
IMPS_SHARES, OTHER_SHARES = {"Mobile_App": 70, "Net_Banking": 30}, {"Mobile_App": 60, "Net_Banking": 30, "Branch": 10}


def shared_out(key: Column, shares: dict[str, int]) -> Column:
    """One of the names by a hash of the key, each with its share in per cent: the same key gets the same name."""
    place, found, upto = F.pmod(F.xxhash64(key), F.lit(100)), None, 0
    for name, share in shares.items():
        upto += share
        found = F.when(place < upto, name) if found is None else found.when(place < upto, name)
    return found


def channel_of_mode(mode: Column | str, key: Column | str) -> Column:
    """The channel that a transfer's mode tells; where it leaves it open, by a hash of the key."""
    m, found = F.upper(_col(mode)), F
    for channel, words in CHANNELS:
        hit = F.lit(False)
        for w in words:
            hit = hit | (m == w[1:] if w.startswith("=") else m.contains(w))
        found = found.when(hit, shared_out(_col(key), IMPS_SHARES) if channel is None else F.lit(channel))
    return found.otherwise(shared_out(_col(key), OTHER_SHARES))


#: Narrations of made statements by mode: of what is paid, of what is received. {ref} and {name} are filled in.
NARRATIONS = {
    "UPI": ("UPI-{name}@ok-{ref}", "UPI-{name}@ok-{ref}-CR"),
    "IMPS": ("IMPS-{ref}-{name}", "IMPS-{ref}-{name}-CR"),
    "NEFT": ("NEFT DR-{ref}-{name}", "NEFT CR-{ref}-{name}"),
    "ATM": ("ATM {ref}", "ATM REVERSAL {ref}"),
    "Cash Deposit": ("CASH {ref}", "BY CASH {ref}"),
    None: ("TXN {ref}", "TXN {ref} CR"),
}


def narration(mode: Column | str, paid: Column | str, ref: Column | str, name: Column | str) -> Column:
    """The narration of a made transfer, by its mode and side."""
    fill = {"{ref}": _col(ref), "{name}": _col(name)}

    def text(template: str) -> Column:
        return F.concat(*(fill.get(part, F.lit(part)) for part in re.split(r"(\{\w+\})", template) if part))

    found = F
    for m, (out, back) in NARRATIONS.items():
        one = F.when(_col(paid), text(out)).otherwise(text(back))
        found = found.otherwise(one) if m is None else found.when(_col(mode) == m, one)
    return found


#: Merchants that a mode implies.
MODE_MERCHANTS = {"ATM": "ATM Withdrawal", "Cash Deposit": "Cash Deposit"}


def merchant_category(merchant: Column | str, categories: dict[str, str], default: str = "Bank") -> Column:
    """The merchant's category in the table, else ``default``."""
    table = F.create_map(*(F.lit(x) for pair in categories.items() for x in pair))
    return F.coalesce(table[_col(merchant)], F.lit(default))


def merchant_of(mode: Column | str, merchant: Column | str) -> Column:
    """The merchant that the mode implies, else the one given."""
    found = F
    for m, name in MODE_MERCHANTS.items():
        found = found.when(_col(mode) == m, name)
    return found.otherwise(_col(merchant))


def name_variant(name: Column | str, key: Column | str) -> Column:
    """The name as it is, with its second part as an initial, in lower case, or its first part alone, by a hash of the key. One part stays; null is Unknown."""
    n = F.trim(_col(name))
    parts = F.split(n, r"\s+")
    which = F.pmod(F.xxhash64(_col(key)), F.lit(4))
    varied = F.when(which == 0, _col(name)).when(which == 1, F.concat(F.get(parts, F.lit(0)), F.lit(" "), F.substring(F.get(parts, F.lit(1)), 1, 1), F.lit("."))).when(which == 2, F.lower(_col(name))).otherwise(F.get(parts, F.lit(0)))
    return F.when(_col(name).isNull(), "Unknown").when(F.size(parts) == 1, _col(name)).otherwise(varied)


def iso_time(c: Column | str) -> Column:
    """ISO 8601 without zone; microseconds where there are any."""
    c = _col(c)
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.concat(whole, F.lit("."), F.date_format(c, "SSSSSS")))


def raised(score: Column | str, by: float, most: float = 100.0) -> Column:
    """The score raised, up to ``most``."""
    return F.least(_col(score) + F.lit(by), F.lit(most))


def salary_per_month(c: Column | str) -> Column:
    return F.round(F.regexp_replace(_col(c).cast("string"), "[^0-9]", "").try_cast("double") / 12).cast("long")


def id_number(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), "([0-9]+)", 1).try_cast("long")


def is_ipv4_shape(c: Column | str) -> Column:
    return _col(c).rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$")
