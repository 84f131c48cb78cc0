"""Language ID by interpolated Kneser-Ney character models.

Each language has a model of ORDER characters, learned from a bounded sample
of labelled rows: about SAMPLE documents of each of the LANGS most frequent
languages, chosen by hash of id, and of their n-grams the GRAMS most frequent.
The counts are Spark aggregates; only the sample's texts are moved. A model is
a set of sorted arrays of n-gram hashes with their probabilities. The whole
text of every document is scored: the language with the least cross-entropy per
character wins, the first by name of equal ones. Where a language has labelled
documents enough, a part of its sample is kept out of the counts; it calibrates
the score and the cross-entropy beyond which a text is rejected as none of the
languages. The kept-out texts are scored where they are, and only their
cross-entropies reach the driver.

What op10 and its parts do with hard rows: a null or empty text, or one
without a letter, is und, with score 0, and rejected. Repeated rows get the
same result, and count each time where they are learned from. A row whose text
or lang is null teaches nothing. A null doc_id is not held out. Other columns
are not looked at. No rows: no rows; nothing to learn from: all is und.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER, SAMPLE, KEPT_OUT = 4, 400, 5
#: Bounds of the model: languages, and n-grams of all of them.
LANGS, GRAMS = 200, 4_000_000
#: Labelled documents that a language has if a part of them is kept out of its counts.
ENOUGH = 10
#: Nats per character, for a text of one character, that short texts may lie above the calibrated bound.
SLACK = 5.0
#: Characters of letters that are cut or scored at once, for bounded memory: an Arrow batch may have 30 MB of them.
CHUNK = 1 << 18
MUL = np.uint64(0x9E3779B97F4A7C15)
#: Letters with the marks on them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letters(text: str | None) -> str:
    """Letters in lower case, every run of other characters as one space; empty if there is no letter."""
    return " ".join(LETTERS.findall((text or "").lower()))


def runs(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """letters() of texts in lists of CHUNK characters at most, or of one longer text; one empty list for no texts."""
    part, n = [], 0
    for x in map(letters, texts):
        if part and n + len(x) > CHUNK:
            yield part
            part, n = [], 0
        part.append(x)
        n += len(x)
    yield part


def codes(text: str) -> np.ndarray:
    """Code points of text after ORDER - 1 spaces, with a space at the end."""
    return np.frombuffer((" " * (ORDER - 1) + text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at each place from ORDER - 1 on."""
    h = np.zeros(len(c) - ORDER + 1, dtype=np.uint64)
    for k in range(n - 1, -1, -1):
        h = (h + c[ORDER - 1 - k : len(c) - k] + np.uint64(1)) * MUL
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """Of all languages: keys are the sorted hashes of each order's n-grams; a, b are [key, language]."""

    langs: list[str]
    keys: list[np.ndarray]  # by order 1..ORDER: n-grams
    a: list[np.ndarray]  # discounted share of the n-gram in its context
    contexts: list[np.ndarray]  # by order 2..ORDER: sorted hashes of contexts
    b: list[np.ndarray]  # mass left to the lower order
    base: np.ndarray  # probability of a character never seen, by language
    full: np.ndarray | None = None  # log-probability of each key of the highest order
    sharp: float = 1.0
    worst: np.ndarray | None = None

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray, rows: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full((len(h), rows.shape[1]), missing)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where((keys[at] == h)[:, None], rows[at], missing)

    def probability(self, c: np.ndarray) -> np.ndarray:
        """Of the last character of each row of c (ORDER code points), by language."""
        p = self._find(self.keys[0], _hash_rows(c[:, -1:]), self.a[0], 0.0) + self.base
        for n in range(2, ORDER + 1):
            h = c[:, ORDER - n :]
            left = self._find(self.contexts[n - 2], _hash_rows(h[:, :-1]), self.b[n - 2], 1.0)
            p = self._find(self.keys[n - 1], _hash_rows(h), self.a[n - 1], 0.0) + left * p
        return p

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in nats per character [text, language], characters) of texts in letters()' form."""
        out, size = np.full((len(texts), len(self.langs)), np.inf), np.zeros(len(texts), dtype=np.int64)
        todo = [(i, x) for i, x in enumerate(texts) if x]
        while todo:
            part, n = [], 0
            while todo and (not part or n + len(todo[-1][1]) < CHUNK):
                part.append(todo.pop())
                n += len(part[-1][1])
            each = [codes(x) for _, x in part]
            sums = np.zeros((len(part), len(self.langs)))
            if len(part) == 1:  # a very long text goes in pieces that overlap by the context
                c = each[0]
                for lo in range(0, len(c) - ORDER + 1, CHUNK):
                    sums[0] += self._scores(c[lo : lo + CHUNK + ORDER - 1]).sum(axis=0)
            else:
                c = np.concatenate(each)
                s = self._scores(c)
                ends = np.cumsum([len(x) for x in each])
                # places whose gram reaches into the text before are left out
                keep = np.ones(len(c), dtype=bool)
                keep[: ORDER - 1] = False
                for e in ends[:-1]:
                    keep[e : e + ORDER - 1] = False
                s = s[keep[ORDER - 1 :]]
                counts = np.array([len(x) - ORDER + 1 for x in each])
                sums = np.add.reduceat(s, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
            for (i, x), v in zip(part, sums, strict=True):
                size[i] = len(x) + 1
                out[i] = -v / size[i]
        return out, size

    def _scores(self, c: np.ndarray) -> np.ndarray:
        """Log-probabilities [place, language]; n-grams that no language has are worked out once for each distinct one."""
        h = grams(c, ORDER)
        at = np.minimum(np.searchsorted(self.keys[-1], h), len(self.keys[-1]) - 1)
        s = self.full[at].astype(np.float64)
        miss = np.flatnonzero(self.keys[-1][at] != h)
        if len(miss):
            _, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            rows = miss[first][:, None] + np.arange(ORDER)[None, :]
            s[miss] = np.log(self.probability(c[rows]))[which]
        return s

    def judge_all(self, texts: Iterable[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """judge() of raw texts, run by run."""
        lang, score, rejected = zip(*map(self.judge, runs(texts)), strict=True)
        return [x for part in lang for x in part], np.concatenate(score), np.concatenate(rejected)

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text; und, 0 and rejected without letters."""
        ce, n = self.entropy(texts)
        has = n > 0
        best = np.argmin(ce, axis=1)
        own = ce[np.arange(len(texts)), best]
        with np.errstate(invalid="ignore"):
            gap = np.where(has[:, None], own[:, None] - ce, 0.0)
            score = np.where(has, 1 / np.exp(gap * self.sharp * np.sqrt(np.minimum(n, 400))[:, None]).sum(axis=1), 0.0)
        rejected = ~has | (own > self.worst[best] + SLACK / np.sqrt(np.maximum(n, 1)))
        return [self.langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)], score, rejected


def _hash_rows(c: np.ndarray) -> np.ndarray:
    h = np.zeros(len(c), dtype=np.uint64)
    for k in range(c.shape[1]):
        h = (h + c[:, k] + np.uint64(1)) * MUL
        h ^= h >> np.uint64(29)
    return h


def _kneser_ney(langs: list[str], counts: pd.DataFrame) -> Model:
    """counts: lang, gram (ORDER characters), n. Lower orders count distinct left neighbours."""
    c = np.frombuffer("".join(counts["gram"]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, ORDER)
    lang = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    level = pd.DataFrame({"lang": lang, "n": counts["n"].to_numpy(), **{f"c{k}": c[:, k] for k in range(ORDER)}})
    keys, a, contexts, b, base = [], [], [], [], np.zeros(len(langs))
    for n in range(ORDER, 0, -1):
        cols = [f"c{k}" for k in range(ORDER - n, ORDER)]
        once, twice = (level[level["n"] == k].groupby("lang").size().reindex(range(len(langs)), fill_value=0).to_numpy() for k in (1, 2))
        d = np.clip(np.where(once + 2 * twice > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.9)
        grams_h = _hash_rows(level[cols].to_numpy())
        own = level["lang"].to_numpy()
        if n > 1:
            ctx = _hash_rows(level[cols[:-1]].to_numpy())
            g = pd.DataFrame({"lang": own, "ctx": ctx, "n": level["n"]}).groupby(["lang", "ctx"])["n"].agg(["sum", "size"]).reset_index()
            total = pd.DataFrame({"lang": own, "ctx": ctx}).merge(g, on=["lang", "ctx"], how="left")["sum"].to_numpy()
            ck, at = np.unique(g["ctx"].to_numpy(), return_inverse=True)
            left = np.ones((len(ck), len(langs)))
            left[at, g["lang"]] = d[g["lang"]] * g["size"] / g["sum"]
            contexts.append(ck)
            b.append(left)
        else:
            sums = np.bincount(own, weights=level["n"], minlength=len(langs))
            kinds = np.bincount(own, minlength=len(langs))
            total = sums[own]
            base = d * kinds / np.maximum(sums, 1) / (kinds + 1) + 1e-9
        k, at = np.unique(grams_h, return_inverse=True)
        share = np.zeros((len(k), len(langs)))
        share[at, own] = (level["n"].to_numpy() - d[own]) / total
        keys.append(k)
        a.append(share)
        if n > 1:
            level = level.groupby(["lang", *cols[1:]]).size().rename("n").reset_index()
    m = Model(langs, keys[::-1], a[::-1], contexts[::-1], b[::-1], base)
    first = np.unique(_hash_rows(c), return_index=True)[1]
    m.full = np.log(m.probability(c[first])).astype(np.float32)  # in the order of keys, as both are sorted by hash
    return m


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n of each run of texts: the n-grams of ORDER characters of those with a letter."""
    for batch in batches:
        langs = iter(batch.column("lang").to_pylist())
        for part in runs(x.as_py() for x in batch.column("text")):
            found = Counter()
            for x in part:
                lang, x = next(langs), " " * (ORDER - 1) + x + " "
                if len(x) > ORDER:
                    found.update((lang, x[i : i + ORDER]) for i in range(len(x) - ORDER + 1))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "gram", "n"])


def train(labelled: DataFrame, sample: int = SAMPLE, langs: int = LANGS) -> Model:
    """A model from doc_id, text, lang; rows without text or language are left out. About `sample` documents of each language are used.

    Without any labelled row the model has no language and calls every text und.
    """
    from fedseek.llm.common import dropped, stored

    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    per = rows.groupBy("lang").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(langs)
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double") * F.lit(2.0**-53)
    # a row per language goes to all tasks; a text moves only if it is chosen
    chosen = rows.join(F.broadcast(per), "lang").where(h * F.col("docs") < sample)
    out = (F.col("docs") >= ENOUGH) & (F.pmod(F.xxhash64("text", "doc_id"), F.lit(KEPT_OUT)) == 0)
    chosen = stored(chosen.select("text", "lang", out.alias("out")))

    counts = chosen.where("not out").select("lang", "text").mapInArrow(_counted, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.orderBy(F.desc("n"), "lang", "gram").limit(GRAMS).toPandas()
    langs = sorted(counts["lang"].unique())
    if not langs:
        return Model([], [], [], [], [], np.zeros(0))
    counts = counts.sort_values(["lang", "gram"], ignore_index=True)
    m = _kneser_ney(langs, counts)
    sent = labelled.sparkSession.sparkContext.broadcast(m)

    @F.pandas_udf("array<float>")
    def entropies(texts: pd.Series) -> pd.Series:
        parts = [sent.value.entropy(x) for x in runs(texts)]
        return pd.Series([[*c, size] for ce, n in parts for c, size in zip(ce.astype(np.float32), n, strict=True)])

    kept = chosen.where("out").select("lang", entropies("text").alias("e")).toPandas()
    dropped(chosen)
    found = np.array(list(kept["e"]), dtype=np.float64).reshape(len(kept), len(langs) + 1)
    order = np.lexsort((*found.T, kept["lang"].to_numpy(dtype=str)))  # rows come in any order; sums must not
    _calibrate(m, list(kept["lang"].iloc[order]), found[order, :-1], found[order, -1])
    return m


def _calibrate(m: Model, names: list[str], ce: np.ndarray, n: np.ndarray) -> None:
    """From the language, cross-entropies and characters of kept-out texts. sharp: makes their score likeliest. worst: a quarter above the highest cross-entropy of a language's own texts; the highest such bound where a language has none."""
    m.worst = np.full(len(m.langs), np.inf)
    place = {x: i for i, x in enumerate(m.langs)}
    own = np.array([place.get(x, -1) for x in names], dtype=np.int64)
    use = (own >= 0) & (n > 0)
    own, ce, n = own[use], ce[use], n[use]
    if not len(own):
        return
    true = ce[np.arange(len(own)), own]
    for k in range(len(m.langs)):
        m.worst[k] = true[own == k].max() * 1.25 if (own == k).any() else np.inf
    m.worst[np.isinf(m.worst)] = m.worst[np.isfinite(m.worst)].max()
    best = -np.inf
    for t in np.geomspace(0.05, 20, 40):
        like = -np.log(np.exp((true[:, None] - ce) * t * np.sqrt(np.minimum(n, 400))[:, None]).sum(axis=1)).mean()
        if like > best:
            best, m.sharp = like, float(t)


def judged(spark: SparkSession, model: Model, text: str) -> Column:
    """struct(lang, score, rejected) of a text column. The model's size is bounded by the sample."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            if m.langs:
                lang, score, rejected = m.judge_all(texts)
            else:
                lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            yield pd.DataFrame({"lang": lang, "score": np.clip(score, 0.0, 1.0), "rejected": rejected})

    return judge(F.col(text))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs (doc_id, text, lang); learns from rows that are not held out."""
    docs = docs.select("doc_id", "text", "lang")
    m = train(docs.where(~held_out()), sample)
    out = docs.select("doc_id", held_out().alias("held_out"), judged(docs.sparkSession, m, "text").alias("j"))
    return out.select("doc_id", "held_out", F.col("j.lang").alias("lang_pred"), F.col("j.score").alias("score"), F.col("j.rejected").alias("rejected"))


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows whose text is in none of the learned languages; all columns as they were."""
    from fedseek.llm.common import free_name

    (j,) = free_name(docs, "lang_judged")
    m = train(docs.select("doc_id", "text", "lang").where(~held_out()), sample)
    return docs.withColumn(j, judged(docs.sparkSession, m, "text")).where(~F.col(f"{j}.rejected")).drop(j)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedseek.llm.common import documents

    return identified(documents(spark, sf_dir))
