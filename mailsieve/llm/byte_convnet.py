"""Language identification with a byte convolutional network.

Texts are cut into windows of ``WINDOW`` bytes. In each window filters of several widths slide
over the bytes, every filter keeps its maximum, and a softmax layer turns the maxima into
language probabilities; a text's probabilities are the means over all its windows, weighted by
their bytes. The network is trained here with numpy (Adam, cross entropy) on windows of a
bounded sample: about ``PER_LANGUAGE`` labelled texts of each language, ``WINDOWS_PER_TEXT``
windows of each. Bytes are folded first: A-Z to a-z, then to the ``SYMBOLS`` - 1 most frequent
ones of the sample and one for all others. Applying it needs no shuffle; filters read pairs of
bytes from tables, a block of windows at a time.

Defined cases: a null text and a text without letters are ``und`` with score 0; training rows
without text or language are ignored; without any training row every text is ``und``. Other
columns are passed through; a column named like an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import slices

WINDOW = 256
SYMBOLS = 64
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANGUAGE = 800
WINDOWS_PER_TEXT = 4
UNKNOWN = "und"
_SLICE_BYTES = 1 << 20
_BLOCK = 192  # windows at a time, so that intermediate arrays stay in cache
_EPOCHS, _BATCH, _RATE = 4, 64, 0.01


def training_windows(
    docs: DataFrame, id_column: str, text_column: str, language_column: str, per_language: int = PER_LANGUAGE
) -> list[tuple[str, str]]:
    """``(text, language)`` windows at hashed places of about ``per_language`` texts of each language.

    At most ``2 * per_language * WINDOWS_PER_TEXT`` windows of each language reach the driver."""
    text, language = F.col(f"`{text_column}`"), F.col(f"`{language_column}`")
    labelled = docs.where(text.isNotNull() & language.isNotNull()).where(text.rlike(r"\p{L}"))
    found = labelled.groupBy(language.alias("language")).count().collect()
    if not found:
        return []
    key = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))
    share = F.create_map(*[F.lit(x) for r in found for x in (r[0], min(1.0, per_language / r[1]))])
    chance = F.pmod(F.xxhash64(key, F.lit("train")), F.lit(1 << 20)) / float(1 << 20)
    places = [
        F.substring(
            text,
            (F.pmod(F.xxhash64(key, F.lit(i)), F.greatest(F.length(text) - WINDOW + 1, F.lit(1))) + 1).cast("int"),
            F.lit(WINDOW),
        )
        for i in range(WINDOWS_PER_TEXT)
    ]
    sample = labelled.where(chance < F.element_at(share, language)).select(
        F.explode(F.array_distinct(F.array(*places))).alias("window"), language.alias("language")
    )
    rows = sample.limit(2 * per_language * WINDOWS_PER_TEXT * len(found)).collect()
    return sorted((r.window, r.language) for r in rows)


@dataclass
class Network:
    languages: list[str]
    fold: np.ndarray  # symbol of each byte
    filters: dict[int, np.ndarray]  # width -> [width, SYMBOLS, FILTERS]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Per width, tables of filter sums for pairs of symbols, and a last one for a single symbol."""
        out = []
        for width, f in self.filters.items():
            pairs = [
                (f[i][:, None, :] + f[i + 1][None, :, :]).reshape(SYMBOLS * SYMBOLS, FILTERS)
                for i in range(0, width - 1, 2)
            ]
            out.append(pairs + ([f[width - 1]] if width % 2 else []))
        return out

    def predict(self, symbols: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Language probabilities of windows ``[n, WINDOW]``."""
        pairs = symbols[:, :-1].astype(np.intp) * SYMBOLS + symbols[:, 1:]
        maxima = []
        for width, parts in zip(self.filters, tables, strict=True):
            n = WINDOW - width + 1
            total = np.take(parts[0], pairs[:, :n], axis=0)
            for k, part in enumerate(parts[1:], 1):
                at = pairs if len(part) > SYMBOLS else symbols
                total += np.take(part, at[:, 2 * k : 2 * k + n], axis=0)
            maxima.append(total.max(axis=1))
        hidden = np.maximum(np.concatenate(maxima, axis=1) + self.bias, 0)
        return _softmax(hidden @ self.weights + self.offset)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _windows(texts: list[bytes], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols ``[n, WINDOW]`` of all windows (padded with symbol 0), their bytes, and their text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // WINDOW)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    symbols = np.zeros(total * WINDOW, np.uint8)
    flat = fold[np.frombuffer(b"".join(texts), np.uint8)]
    starts = np.cumsum(sizes) - sizes
    shift = (ends - counts) * WINDOW - starts
    symbols[np.arange(len(flat)) + np.repeat(shift, sizes)] = flat
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(total) - np.repeat(ends - counts, counts)
    held = np.minimum(WINDOW, sizes[owner] - place * WINDOW)
    return symbols.reshape(total, WINDOW), held, owner


def train(rows: list[tuple[str, str]], seed: int = 7) -> Network | None:
    """The network for (text, language) rows; the same rows give the same network."""
    if not rows:
        return None
    languages = sorted({language for _, language in rows})
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    # A window counts characters in the sample; only its first WINDOW bytes are learned from.
    texts = [t.encode()[:WINDOW] for t, _ in rows]
    seen = np.bincount(lower[np.frombuffer(b"".join(texts), np.uint8)], minlength=256)
    frequent = np.argsort(-seen, kind="stable")[: SYMBOLS - 1]
    to_symbol = np.zeros(256, np.uint8)
    to_symbol[frequent] = np.arange(1, SYMBOLS)
    fold = to_symbol[lower]
    symbols, _, _ = _windows(texts, fold)
    labels = np.array([languages.index(language) for _, language in rows])
    labels = labels[[i for i, t in enumerate(texts) if t]]

    rng = np.random.default_rng(seed)
    p = {w: rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS}
    p |= {
        "bias": np.zeros(FILTERS * len(WIDTHS), np.float32),
        "weights": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        "offset": np.zeros(len(languages), np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    # Languages with few windows count as much as the others.
    share = 1 / np.maximum(np.bincount(labels, minlength=len(languages)), 1)
    importance = (share[labels] / share[labels].mean()).astype(np.float32)
    step = 0
    for _ in range(_EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), _BATCH):
            rows_at = order[at : at + _BATCH]
            x, y, n = symbols[rows_at].astype(np.intp), labels[rows_at], len(rows_at)
            maxima, places = [], []
            for w in WIDTHS:
                length = WINDOW - w + 1
                total = p[w][0][x[:, :length]]
                for j in range(1, w):
                    total += p[w][j][x[:, j : j + length]]
                places.append(total.argmax(axis=1))
                maxima.append(np.take_along_axis(total, places[-1][:, None], axis=1)[:, 0])
            hidden = np.concatenate(maxima, axis=1) + p["bias"]
            active = np.maximum(hidden, 0)
            grad = _softmax(active @ p["weights"] + p["offset"])
            grad[np.arange(n), y] -= 1
            grad *= importance[rows_at, None] / n
            g = {"weights": active.T @ grad, "offset": grad.sum(axis=0)}
            down = (grad @ p["weights"].T) * (hidden > 0)
            g["bias"] = down.sum(axis=0)
            for k, w in enumerate(WIDTHS):
                own = down[:, k * FILTERS : (k + 1) * FILTERS]
                g[w] = np.zeros_like(p[w])
                for j in range(w):
                    np.add.at(g[w][j], (np.take_along_axis(x, places[k] + j, axis=1), np.arange(FILTERS)), own)
            step += 1
            for key, value in g.items():
                first[key] += 0.1 * (value - first[key])
                second[key] += 0.001 * (value * value - second[key])
                scale = np.sqrt(second[key] / (1 - 0.999**step)) + 1e-8
                p[key] -= _RATE * (first[key] / (1 - 0.9**step)) / scale
    return Network(languages, fold, {w: p[w] for w in WIDTHS}, p["bias"], p["weights"], p["offset"])


def identify(docs: DataFrame, network: Network | None, text_column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the probability of that language, from 0 to 1."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "_letters")]
    letters = F.coalesce(F.col(f"`{text_column}`").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*[f"`{c}`" for c in rest], letters.alias("_letters"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "lang_pred string", "score double"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else None
        for part in slices(batches, text_column, _SLICE_BYTES):
            n = part.num_rows
            names, scores = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
            known = np.flatnonzero(np.array(part.column("_letters").to_pylist(), dtype=bool))
            if network and len(known):
                texts = [t.encode() for t in part.column(text_column).take(pa.array(known)).to_pylist()]
                symbols, held, owner = _windows(texts, network.fold)
                total = np.zeros((len(texts), len(network.languages)))
                for at in range(0, len(symbols), _BLOCK):
                    here = slice(at, at + _BLOCK)
                    found = network.predict(symbols[here], tables) * held[here, None]
                    np.add.at(total, owner[here], found)
                total /= total.sum(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                names[known] = np.array(network.languages, dtype=object)[best]
                scores[known] = np.clip(total[np.arange(len(texts)), best], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in rest), pa.array(names, pa.string()), pa.array(scores)],
                names=[*rest, "lang_pred", "score"],
            )

    return rows.mapInArrow(apply, schema)
