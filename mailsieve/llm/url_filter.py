"""URL filter: exact rules, then logistic regression on hashed character n-grams of host and path.

A rule holds for its host and all subdomains if the path starts with the rule's path; the
longest rule wins. Urls without a rule are judged by the model: every n-gram of 3 to 5 bytes of
the host (with start and end marks, without its last label, which says little) and of the path
adds one hashed weight. It is trained in numpy on a small labelled table; ``labelled_urls``
builds the default one from two short word lists. Applying it needs no shuffle.

Defined cases: a null url and one without ``://`` have empty host and path and no rule; no
n-gram means no evidence, and the verdict is allow. Other columns are passed through; a column
named like an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 15
SIZES = (3, 4, 5)
BLOCK_AT = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path

# Words of the labelled table.
_BLOCKED = (
    "pills-online win-casino live-bets xxx-adult adtrack click-ads spam-link cheap-meds replica-shop "
    "fast-loans payday-cash poker-win lottery-prize hot-singles free-money crypto-double miracle-diet "
    "slots-bonus warez-crack torrent-free phish-login malware-drop link-farm seo-spam viagra-deal "
    "porn-tube sexcam-live track-pixel ads-server bets-bonus farm-links pills-sale casino-bonus adult-cams"
).split()
_ALLOWED = (
    "library museum school city-news weather garden recipes travel-notes open-data science history "
    "football sailing theatre cinema music-review painting philosophy algebra physics chemistry biology "
    "gazette tribune herald courier village council parliament hospital clinic university college "
    "thesis research journal archive atlas maps railway airport harbour bakery kitchen carpenter "
    "the-truth earth health north-south youth mathematics brother mother nation station education "
    "motion fiction together gathering anthem lighthouse father panther thunder southern methods "
    "cathedral gothic ethics rhythm python-notes author something within thinker tradition"
).split()


def labelled_urls() -> list[tuple[str, int]]:
    """``(url, 1 for block)``: every word under a few prefixes, endings and neutral paths."""
    frames = [("http://", "com", "/en/12"), ("https://www.", "net", "/de/7.html"), ("https://blog.", "org", "/fr/345/"),
              ("http://m.", "com", "/es/"), ("https://", "net", "/en/9?page=2")]
    return [
        (f"{start}{word}.site.{end}{path}", label)
        for label, words in ((1, _BLOCKED), (0, _ALLOWED))
        for word in words
        for start, end, path in frames
    ]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", 2)


def _grams(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts and the text each belongs to."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    slots, owners = [], []
    for n in SIZES:
        if len(flat) < n:
            continue
        value = np.full(len(flat) - n + 1, n, np.uint32)
        for j in range(n):
            value = value * np.uint32(0x01000193) ^ flat[j : len(flat) - n + 1 + j]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x85EBCA6B)
        value ^= value >> np.uint32(13)
        inside = owner[: len(value)] == owner[n - 1 :]
        slots.append(value[inside] % np.uint32(SLOTS))
        owners.append(owner[: len(value)][inside])
    if not slots:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(slots).astype(np.int64), np.concatenate(owners)


def _features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"^{h.rpartition('.')[0] or h}$".encode() if h else b"" for h in hosts]
    slots, owner = _grams(marked)
    path_slots, path_owner = _grams([f"|{p}".encode() if p else b"" for p in paths])
    # Host and path have halves of the table each.
    half = SLOTS // 2
    return np.concatenate([slots % half, half + path_slots % half]), np.concatenate([owner, path_owner])


def train(urls: Sequence[tuple[str, int]], rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights by gradient descent on the mean log loss; there is no bias, no evidence means 0.5."""
    hosts, paths = [], []
    for url, _ in urls:
        rest = url.partition("://")[2].partition("#")[0].partition("?")[0]
        host, slash, path = rest.partition("/")
        hosts.append(host.translate(str.maketrans(_UPPER, _LOWER)))
        paths.append(slash + path)
    slots, owner = _features(hosts, paths)
    labels = np.array([label for _, label in urls], dtype=np.float64)
    held = np.maximum(np.bincount(owner, minlength=len(urls)), 1)
    scale = 1 / np.sqrt(held)[owner]
    weights = np.zeros(SLOTS)
    for _ in range(rounds):
        z = np.bincount(owner, weights=weights[slots] * scale, minlength=len(urls))
        error = 1 / (1 + np.exp(-z)) - labels
        grad = np.bincount(slots, weights=error[owner] * scale, minlength=SLOTS) / len(urls)
        weights -= rate * (grad * 10 + decay * weights)
    return weights


def probabilities(weights: np.ndarray, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    slots, owner = _features(hosts, paths)
    held = np.maximum(np.bincount(owner, minlength=len(hosts)), 1)
    z = np.bincount(owner, weights=weights[slots], minlength=len(hosts)) / np.sqrt(held)
    return 1 / (1 + np.exp(-z))


def _rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in reversed(longest_first):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found).otherwise(out)
    return out


def judge(urls: DataFrame, weights: np.ndarray, rules: Sequence[Rule] = (), url_column: str = "url") -> DataFrame:
    """``urls`` with ``host, path, rule, verdict`` and ``probability`` (of block, by the model)."""
    added = ("host", "path", "rule", "verdict", "probability", "_rule")
    rest = [c for c in urls.columns if c not in added]
    url = F.col(f"`{url_column}`")
    rows = urls.select(*[f"`{c}`" for c in rest], host_of(url).alias("host"), path_of(url).alias("path"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rows.columns), "probability double"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = probabilities(weights, part.column("host").to_pylist(), part.column("path").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found)], names=[*part.schema.names, "probability"]
                )

    own = F.when(F.col("probability") > BLOCK_AT, F.lit("block")).otherwise(F.lit("allow"))
    return (
        rows.mapInArrow(apply, schema)
        .withColumn("_rule", _rule(F.col("host"), F.col("path"), rules))
        .select(
            *[f"`{c}`" for c in rest], "host", "path", F.col("_rule.rule").alias("rule"),
            F.coalesce("_rule.verdict", own).alias("verdict"), "probability",
        )
    )
