"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick.

Strict words reject a url alone, soft words only when several different ones stand in it. A word counts where no ASCII
letter or digit adjoins it.
"""

from __future__ import annotations

from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import lower_ascii

#: Words that stand for adult, gambling, fraud and malware sites alone.
STRICT = tuple(
    "adult blowjob bukkake camgirl camgirls casino casinos cumshot cumshots dildo erotic escort escorts fetish gambling gangbang handjob hardcore hentai incest jackpot "
    "keygen malware milf nsfw orgasm orgy phishing playboy porn porno pornhub pornography pussy ransomware sex sexcam sexy slut spam spyware striptease "
    "swinger swingers threesome tits torrent torrents trojan viagra voyeur warez whore xhamster xnxx xvideos xxx".split()
)
#: Words that many clean urls have as well.
SOFT = tuple(
    "ads affiliate baccarat bet bets betting bingo blackjack bonus bonuses cams cash cheap cheats cialis click clickbait coupon coupons crack cracked crypto dating deals discount download "
    "earn escrow forex free giveaway hack hacks hot invest jackpots kamagra levitra loan loans lottery lotto mature mortgage naked nude nudes offer offers payday pharmacy pills poker popunder popup "
    "prize profit promo rich roulette serial singles slot slots steroids teen track tracker tracking traffic tube wager win winner winning".split()
)
#: Words of a vocabulary that is given as a table, at most; some 100 bytes each in every Python worker.
MAX_WORDS = 1_000_000
#: The weight of a strict and of a soft word, and the sum of distinct words' weights from which a url is rejected.
STRICT_WEIGHT, SOFT_WEIGHT, REJECT_FROM = 2, 1, 2

#: (verdict, host, path); the longest rule that fits a url decides.
Rule = tuple[str, str, str]


@cache
def _automaton(words: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, weight in words:
        found.add_word(word, (word, weight))
    found.make_automaton()
    return found


def _bare(char: str) -> bool:
    return not (char.isascii() and char.isalnum())


def vocabulary_weight(url: str, words: tuple[tuple[str, int], ...]) -> int:
    """The weights of the distinct vocabulary words in a lower-cased url."""
    if not url or not words:
        return 0
    met = {}
    for last, (word, weight) in _automaton(words).iter(url):
        begin = last - len(word) + 1
        if (begin == 0 or _bare(url[begin - 1])) and (last + 1 == len(url) or _bare(url[last + 1])):
            met[word] = weight
    return sum(met.values())


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without '://'."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(vocabulary: DataFrame) -> tuple[tuple[str, int], ...]:
    """The words of a vocabulary table (word, weight), A-Z lower-cased, each with its largest weight; more than MAX_WORDS are refused."""
    words = vocabulary.select(lower_ascii(F.trim("word")).alias("word"), F.col("weight").cast("int")).where("word <> '' AND weight > 0")
    found = words.groupBy("word").agg(F.max("weight").alias("weight")).limit(MAX_WORDS + 1).collect()
    if len(found) > MAX_WORDS:
        raise ValueError(f"a vocabulary of more than {MAX_WORDS} words")
    return tuple(sorted((r.word, r.weight) for r in found))


def filter_urls(pages: DataFrame, rules: list[Rule], strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, vocabulary: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    The words are ``strict`` and ``soft`` or, where it is given, those of the table ``vocabulary`` (word, weight).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest decides, and the
    vocabulary judges what no rule fits. A null or empty url, or one without '://', has an empty host and path, and is
    judged by its words like any other. Repeated rows stay; other columns are not read.
    """
    words = listed(vocabulary) if vocabulary is not None else tuple((w, STRICT_WEIGHT) for w in strict) + tuple((w, SOFT_WEIGHT) for w in soft)

    @F.pandas_udf("int")
    def weight(urls: pd.Series) -> pd.Series:
        return pd.Series([vocabulary_weight(u, words) for u in urls], dtype="int32")

    url = F.col("url").cast("string")
    judged = pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path"), weight(lower_ascii(F.coalesce(url, F.lit("")))).alias("weight"))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("weight") >= REJECT_FROM, "block").otherwise("allow")
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.col("weight").alias("vocabulary_weight"))
