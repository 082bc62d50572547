"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, with A-Z lower-cased; the path is the rest up to ``?``, ``#`` or the end;
both are empty where the url is null or has no ``://``. A rule fits its host
and all subdomains, if the path starts with the rule's; the longest fitting
rule wins (of equally long ones that with the longer host, then block). Where
no rule fits, the model decides.

Defined results: empty hosts and paths (of a null url, or one without ``://``)
are judged by the model; a null page_id stays null beside its verdict; repeated
rows are judged alike; a tie at the threshold blocks; a very long url is judged
whole; extra columns change nothing, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Host of a url, '' without one."""
    host = F.regexp_extract(_after(url), r"\A[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path of a url, '' without one."""
    return F.coalesce(F.regexp_extract(_after(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


@dataclass(frozen=True)
class Rule:
    """verdict is 'allow' or 'block'; text is host and path, as in 'example.org/private/'."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(text, verdict) of the winning rule, or null. One expression a rule, for lists of some dozens."""
    rank = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block"))
    fits = [(host.eqNullSafe(r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)) for r in rank]
    won = [F.when(fit, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))) for r, fit in zip(rank, fits, strict=True)]
    return F.coalesce(*won, F.lit(None).cast("struct<text:string,verdict:string>"))


def grams(texts: Sequence[str], mark: int, sizes: Sequence[int], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the hashed n-grams of texts; a text shorter than n is one gram. Digits count alike."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4").astype(np.uint64)
    codes[(codes >= 48) & (codes <= 57)] = 48
    row = np.repeat(np.arange(len(texts)), lengths + 1)
    left = np.repeat(np.cumsum(lengths + 1), lengths + 1) - 1 - np.arange(len(codes))  # characters up to the row's end
    rows, columns = [], []
    for n in sizes:
        size = np.minimum(lengths, n)[row]
        first = np.flatnonzero((left >= size) & (size > 0))
        h = np.full(len(first), mark * 64 + n, np.uint64)
        for k in range(n):
            inside = k < size[first]
            h[inside] = mix(h[inside] + codes[first[inside] + k] * np.uint64(0x9E3779B97F4A7C15))
        rows.append(row[first])
        columns.append((h % np.uint64(dims)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(columns)


def features(hosts: Sequence[str], paths: Sequence[str], sizes: Sequence[int], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column) of the distinct features of urls, and how many each has: n-grams of the host (between marks) and of the path, and one that all have."""
    parts = [grams([f"^{h}$" for h in hosts], 1, sizes, dims), grams([f"{p}$" for p in paths], 2, sizes, dims), (np.arange(len(hosts)), np.zeros(len(hosts), np.int64))]
    keys = np.unique(np.concatenate([r * dims + c for r, c in parts])) if len(hosts) else np.zeros(0, np.int64)
    return keys // dims, keys % dims, np.bincount(keys // dims, minlength=len(hosts))


@dataclass(frozen=True)
class UrlModel:
    """Weights of a logistic regression over hashed n-grams; dims bounds its size (512 kB)."""

    weights: np.ndarray
    sizes: tuple[int, ...]

    def probabilities(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """How likely each url is unwanted; all urls at once."""
        row, column, n = features(hosts, paths, self.sizes, len(self.weights))
        return 1 / (1 + np.exp(-np.clip(np.bincount(row, self.weights[column], len(hosts)) / np.sqrt(np.maximum(n, 1)), -30, 30)))

    def probability(self, host: str, path: str) -> float:
        return float(self.probabilities([host], [path])[0])


def fit(labelled: Sequence[tuple[str, str, int]], sizes: tuple[int, ...] = (3, 4, 5), dims: int = 1 << 16, epochs: int = 300, rate: float = 0.5, decay: float = 1e-3) -> UrlModel:
    """Full-batch gradient descent on the small table of (host, path, blocked)."""
    rows, columns, n = features([h for h, *_ in labelled], [p for _, p, _ in labelled], sizes, dims)
    y = np.array([label for *_, label in labelled], float)
    value = 1 / np.sqrt(np.maximum(n, 1))
    w = np.zeros(dims)
    for _ in range(epochs):
        z = np.bincount(rows, w[columns], len(y)) * value
        slope = (1 / (1 + np.exp(-z)) - y) / max(1, len(y)) * value
        w -= rate * (len(y) * np.bincount(columns, slope[rows], dims) + decay * w)
    return UrlModel(w, sizes)


#: Words of the labelled table's hosts; each host is made of one or two of its class.
WANTED = (
    "thering ontion tional therest library museum school weather news garden travel recipes science forum history music art book city county health doctor clinic law court bank "
    "insurance energy water forest river ocean mountain island bird animal farm kitchen bakery coffee wine cheese bread market store craft wood metal paper print photo film theatre "
    "radio journal review letter poetry language math physics chemistry biology astronomy geology climate college academy research institute society church family parent child baby "
    "sport football tennis cycling running swimming chess puzzle open source code software data network cloud robot engine auto train airport hotel camping tour map guide help wiki "
    "archive gallery design fashion home house building tools repair job career office project team street park village north south green blue red old new first world local daily "
    "the that than this thing things think thought three then them there these those they their other another others with within without while where when which what white whole "
    "who why how have having had has and ant end hand land sand stand standing under understand her here hers over ever never every very an any many man men ten often "
    "or for more most must order story short shore sure in on into onto upon its it is as at ate are area read real reach teach each because please ease east west rest test best "
    "tion nation station action motion option caption edition lotion ration question section able table stable possible visible noble double ly only early daily weekly friendly family "
    "ed red need used shared sh she show shop fish wish fresh english st still study start stone ou out our house you your south sound found through thorough nt went want different sent"
).split()
UNWANTED = (
    "casino bonus bingo poker slots jackpot roulette blackjack gambling wager betting bets bet win winner prize lottery lotto cheap discount pills viagra cialis pharma meds rx tablets "
    "steroids xanax tramadol slimming diet adult xxx x porn sex cams nude escort milf hentai erotic dating hookup free loans payday credit cash money rich forex crypto bitcoin doubler ads "
    "adserver adclick banner popup popunder click clicks traffic track tracker tracking pixel beacon telemetry spam spammer bulk mailer seo backlink backlinks link links farm warez crack "
    "cracked keygen serial nulled torrent pirate hack cheats malware phishing scam fake replica rolex counterfeit giveaway survey miracle"
).split()
SUBDOMAINS, TOPS = ("", "www.", "blog.", "m."), ("com", "org", "net")
PLAIN_PATHS, ENDINGS = ("/en/", "/de/", "/fr/", "/es/", "/"), ("", "/", ".html")
OWN_PATHS = (("/articles/", "/archive/", "/library/", "/recipes/"), ("/win-bonus/", "/buy-cheap-pills/", "/ads/click/", "/crack-download/"))
#: Hosts that the table leaves out, so that they can measure the model.
LEFT_OUT = ("casino-win", "free-bets", "cheap-pills", "ads-track", "spam-farm", "adult-x")


def made_hosts(words: Sequence[str]) -> list[str]:
    """Each word alone, and with three others, joined by a hyphen or not."""
    n, pairs = len(words), []
    for i, one in enumerate(words):
        pairs += [one + mark + words[(i * step + gap) % n] for mark, step, gap in (("-", 1, 1), ("-", 7, 5), ("", 5, 3), ("-", 11, 8))]
    return [h for h in dict.fromkeys([*words, *pairs]) if h not in LEFT_OUT]


def labelled_urls() -> list[tuple[str, str, int]]:
    """The labelled table: made hosts and paths, wanted (0) and unwanted (1).

    Both classes go through the same subdomains, top levels, plain paths,
    numbers and endings in the same order, so that these do not tell the
    classes apart; every fifth path is one of the class's own.
    """
    rows = []
    for label, words in enumerate((WANTED, UNWANTED)):
        for i, host in enumerate(made_hosts(words)):
            path = OWN_PATHS[label][i // 5 % 4] if i % 5 == 0 else PLAIN_PATHS[i // 12 % 5]
            path += f"{37 * i % 10 ** (1 + i // 4 % 3)}{ENDINGS[i // 7 % 3]}"
            rows.append((f"{SUBDOMAINS[(i + i // 4) % 4]}{host}.example.{TOPS[i % 3]}", path, label))
    return rows


def judge(pages: DataFrame, rules: Sequence[Rule], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            yield pd.Series(model.probabilities(hosts.tolist(), paths.tolist()))

    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = split.withColumn("score", score("host", "path")).withColumn("won", best_rule(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", F.col("won.text").alias("rule"), F.coalesce("won.verdict", by_model).alias("verdict"), "score")
