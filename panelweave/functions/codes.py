"""Security codes and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Code prefixes by exchange and board, and the short-name markers of risk states.
SSE_ANY, SZSE_ANY, BSE_ANY = ("900", "5", "6"), ("0", "1", "2", "3"), ("4", "8", "9")
SSE_A = ("600", "601", "603", "605", "688", "689")
SZSE_A = ("000", "001", "002", "003", "300", "301", "302")
BSE_A = ("920", "43", "83", "87", "88")
STAR_A, CHINEXT_A, CDR = ("688", "689"), ("300", "301", "302"), "689"
TRANSIENT, DELISTING_START, DELISTING_END = "^(?:XD|XR|DR|N|C)", "退市", "退"
MARKETS = {"SSE": "sh", "SZSE": "sz", "BSE": "bj"}
# Full-width ASCII and the ideographic space, the compatibility forms exchange names use.
WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def starts(code: Column, prefixes: tuple[str, ...] | str) -> Column:
    return code.rlike("^(?:" + "|".join([prefixes] if isinstance(prefixes, str) else prefixes) + ")")


def exchange(code: Column) -> Column:
    return (F.when(starts(code, SSE_ANY), "SSE").when(starts(code, SZSE_ANY), "SZSE")
            .when(starts(code, BSE_ANY), "BSE").otherwise("UNKNOWN"))


def is_a_share(code: Column) -> Column:
    return starts(code, SSE_A + SZSE_A + BSE_A)


def board(code: Column) -> Column:
    return (F.when(starts(code, STAR_A), "STAR").when(starts(code, SSE_A), "SSE_MAIN")
            .when(starts(code, CHINEXT_A), "CHINEXT").when(starts(code, SZSE_A), "SZSE_MAIN")
            .when(starts(code, BSE_A), "BSE").otherwise("UNKNOWN"))


def security_type(code: Column) -> Column:
    return F.when(starts(code, CDR), "CDR").otherwise("A_SHARE")


def instrument_id(code: Column) -> Column:
    return F.concat_ws(".", F.lit("CN"), exchange(code), code)


def market_code(code: Column) -> Column:
    """Code with its sh/sz/bj prefix (sz where the exchange is unknown)."""
    prefix = F.lit("sz")
    for name, short in MARKETS.items():
        prefix = F.when(exchange(code) == name, short).otherwise(prefix)
    return F.when(starts(code, ("sh", "sz", "bj")), code).otherwise(F.concat(prefix, code))


def clean_name(name: Column) -> Column:
    """Full-width forms narrowed, blanks removed."""
    return F.regexp_replace(F.translate(name, WIDE, NARROW), r"\s+", "")


def risk_status(name: Column) -> Column:
    """Risk state written in a short name: DELISTING, *ST, ST or null; day markers are looked through."""
    text = F.upper(clean_name(name))
    bare = F.regexp_replace(text, TRANSIENT, "")
    status = F.when(text.endswith(DELISTING_END) | text.startswith(DELISTING_START), "DELISTING")
    for candidate in (text, bare):
        status = status.when(candidate.rlike(r"^S?\*ST"), "*ST").when(candidate.rlike(r"^S?ST"), "ST")
    return status
