"""White space, offsets, language codes and small string rules, as column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the document model counts it, for Java, RE2 and Python patterns.
WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
PY_WS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Bibliographic three-letter codes that differ from the terminological ones.
BIBLIOGRAPHIC = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de",
    "gre": "el", "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
}
#: Two-letter codes that the standard has withdrawn.
WITHDRAWN = {"in", "iw", "ji", "jw", "mo", "sh"}
#: Media types by file extension.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}
OTHER_MEDIA = "application/octet-stream"


#: The same characters, spelled out.
WS_CHARS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_ws(x: Column) -> Column:
    return F.btrim(x, F.lit(WS_CHARS))


def normalize_ws(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(x, f"[{WS}]+", " "))


def u16(x: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.shiftright(F.octet_length(F.encode(x, "UTF-16BE")), 1)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if its source gives fewer: one task reads a file of one
    row group, however much work its rows are. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@lru_cache(1)
def language_codes(spark: SparkSession) -> tuple[frozenset[str], dict[str, str]]:
    """Two-letter codes, and three-letter codes with theirs, from the JVM's own ISO 639 tables."""
    locale = spark.sparkContext._jvm.java.util.Locale
    two = frozenset(locale.getISOLanguages()) - WITHDRAWN
    three = {locale.forLanguageTag(c).getISO3Language(): c for c in sorted(two)} | BIBLIOGRAPHIC
    return two, {k: v for k, v in three.items() if len(k) == 3}


def reduced_language(spark: SparkSession, code: str) -> str | None:
    """The two-letter code of a tag, on the driver."""
    two, three = language_codes(spark)
    primary = code.strip().replace("_", "-").split("-")[0].lower()
    return primary if primary in two else three.get(primary)


def normalize_language(spark: SparkSession, declared: Column, fallback: str) -> Column:
    """Two-letter code of a declared tag, else of the fallback. A fallback that is no language is an
    error of the caller."""
    default = reduced_language(spark, fallback)
    if default is None:
        raise ValueError(f"fallback {fallback!r} is not an ISO 639-1 language")
    two, three = language_codes(spark)
    known = F.create_map(*(F.lit(x) for kv in ({c: c for c in sorted(two)} | three).items() for x in kv))
    primary = F.lower(F.element_at(F.split(trim_ws(declared), "[-_]"), 1))
    return F.coalesce(F.try_element_at(known, primary), F.lit(default))
