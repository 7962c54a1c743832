"""URL filter: rules on host and path, and logistic regression for the rest.

The classifier is a logistic regression on hashed character n-grams of host and path, trained from
a small labelled table of URLs on the driver; its weights are one array of fixed size. A rule fits
its host and all subdomains if the path starts with the rule's path; the longest fitting rule
decides before the classifier does.

Defined results: a null URL and one without :// have empty host and path, fit no rule and are judged
by the classifier; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Names of the training table, to block and to allow; each is a host of its own.
BLOCKED = (
    "casino-spin luckycasino casino-bonus online-casino poker-spin pokerbonus lucky-poker slots-bonus luckyslots jackpot-slots jackpot-bets sportbets betsonline bets-bonus lotto-jackpot "
    "viagra-online cheapviagra buy-viagra pills-online diet-pills buypills pharma-pills cheap-pharma meds-online cheapmeds discount-meds payday-cash cashloans loans-online quick-payday cheap-loans "
    "porn-cams xxxporn freeporn adult-cams adultxxx free-adult xxx-dating adultdating sex-cams freesex sexdating escort-dating escort-sex spam-links spambot linkspam linkfarm-hub seo-links seospam buy-backlinks "
    "phish-login phishing-mail mail-phish malware-files malwarebot virus-malware crackfiles crack-keygen warez-crack freewarez torrent-warez "
    "ads-server adserver ads-click clickads popup-ads trackclick click-tracker adtrack tracker-ads free-prize win-prizes prizewinner win-cash freegift replica-rolex cheap-replica "
    "spam-mail buyspam poker-casino slots-casino bets-poker viagra-pills pharma-meds buy-meds loans-cash quick-loans payday-loans porn-sex adult-porn escort-cams seo-linkfarm phish-mail malware-bot torrent-crack keygen-warez popup-click win-jackpot"
).split()
ALLOWED = (
    "townlibrary artmuseum highschool cityuniversity newspaper dailynews weather-station family-recipes cooking gardening flowers traveller mountains hiking rivers forest island village council parliament hospital medicine nursing "
    "physics chemistry astronomy mathematics history archive manual dictionary grammar translation poetry novels bookshop reading writers journal magazine orchestra concert theatre cinema painting gallery architecture furniture carpentry "
    "workshop engineering railway bicycles football tennis swimming chess-club puzzles children teachers learning lessons software developers programming database open-source electronics computing research institute laboratory foundation "
    "charity volunteers community farming orchard bakery coffeehouse restaurant pottery ceramics knitting heather motion thistle thread northern portable notable reasonable sterling winding eastern wherever together brother"
).split()


def training_table() -> list[tuple[str, int]]:
    """URLs and labels, 1 to block. Scheme, first label, top domain and path go round by their own counts,
    so that they tell nothing about the label."""
    first, top, path = ("", "www.", "m.", "blog."), ("com", "net", "org"), ("/en/12", "/de/81", "/fr/7?page=2", "/es/40.html", "/en/333#top", "/15/", "")
    return [(f"http{'s' * (k % 2)}://{first[k % 4]}{name}.example.{top[k % 3]}{path[k % 7]}", y) for names, y in ((BLOCKED, 1), (ALLOWED, 0)) for k, name in enumerate(names)]


LABELLED = training_table()


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict of the longest fitting rule, else null. rules: verdict, host, path;
    they are a fixed list, tried from the longest on."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def hashed(host: str, path: str, bits: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Slots of the n-grams of host and path, each once."""
    found = set()
    for mark, part in ((b"h", host), (b"p", path)):
        data = b"^" + part.encode("utf-8", "surrogatepass") + b"$"
        for n in sizes:
            found.update(mark + data[i : i + n] for i in range(len(data) - n + 1))
    return np.fromiter(sorted({zlib.crc32(g) & ((1 << bits) - 1) for g in found}), np.int64)


def fit(rows: list[tuple[str, str, int]], bits: int = 14, sizes: tuple[int, ...] = (3, 4), ridge: float = 0.002, steps: int = 1500) -> np.ndarray:
    """Weights of the slots, the bias last, from (host, path, label): full gradient descent with the
    features of a URL scaled to length one. rows is small; every step uses them all."""
    found = [hashed(host, path, bits, sizes) for host, path, _ in rows]
    slots = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))  # the others stay at zero
    x = np.zeros((len(rows), len(slots) + 1))
    for r, at in zip(x, found):
        r[np.searchsorted(slots, at)] = 1 / np.sqrt(max(1, len(at)))
        r[-1] = 1
    y = np.array([r[2] for r in rows], float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= 4.0 * (x.T @ (p - y) + ridge * np.r_[w[:-1], 0]) / max(1, len(y))
    out = np.zeros((1 << bits) + 1)
    out[slots], out[-1] = w[:-1], w[-1]
    return out


def with_probability(pages: DataFrame, weights: np.ndarray, host: str = "host", path: str = "path", out: str = "probability", bits: int = 14, sizes: tuple[int, ...] = (3, 4)) -> DataFrame:
    """pages with the probability that a URL is to be blocked."""

    @F.pandas_udf("double")
    def probability(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for h, p in zip(hosts, paths):
            at = hashed(h, p, bits, sizes)
            out.append(weights[at].sum() / np.sqrt(max(1, len(at))) + weights[-1])
        return pd.Series(1 / (1 + np.exp(-np.array(out, float))))

    return pages.withColumn(out, probability(F.col(host), F.col(path)))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as host_and_path has them, for the training table."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[end:]
    cut = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return rest[:end].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), tail[:cut]


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; rule and verdict are null where none fits."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    return rows.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "hit.*")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled=LABELLED, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, probability, verdict) of every row. Weights are a few dozen KB."""
    weights = fit([(*split_url(u), y) for u, y in labelled])
    rows = with_probability(ruled(pages, rules, url, page_id), weights)
    by_model = F.when(F.col("probability") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", "probability", F.coalesce("verdict", by_model).alias("verdict"))
