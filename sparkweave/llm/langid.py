"""Language identification by hierarchical discrimination.

Linear support vector machines over hashed byte bigrams and trigrams of the letters of a text first choose the language
family (one against the rest); within the family one-versus-one machines separate the related languages by votes, ties by
the sum of margins. Sigmoids fitted on a part of the sample that the machines don't see turn margins into the score, the
product of the family's and the language's probability.

The machines learn from at most SAMPLE labelled rows a language (SAMPLE_ALL in all), chosen by a hash of the identifier,
each as a whole and as its first words; every text is predicted whole. A null text or one without any letter is `und`
with score 0, as is everything when there is nothing to learn from. Languages that FAMILIES doesn't know are families of
their own. Rows that repeat get the same prediction, whatever their identifiers; long texts are counted in steps; other columns are
left aside. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm._common import clean_id, in_batches, pieces, released, table

#: Buckets of hashed n-grams.
DIM = 2048
#: Labelled rows to learn from: of a language, and in all.
SAMPLE, SAMPLE_ALL = 800, 6400
#: Words of the short form of a sampled text.
SHORT = 6
#: Bytes of text worked on at once.
STEP = 1 << 20
#: Families of languages by ISO 639-1 code (fixed values).
FAMILIES = {
    "romance": "ca es fr gl it oc pt ro".split(),
    "germanic": "af da de en is lb nl no sv".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "baltic": "lt lv".split(),
    "turkic": "az kk tr uz".split(),
    "indic": "bn gu hi mr ne pa ur".split(),
    "iranian": "fa ku ps tg".split(),
    "semitic": "am ar he mt".split(),
    "celtic": "br cy ga gd".split(),
    "austronesian": "id jv ms tl".split(),
}
UNKNOWN = "und"


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def byte_kinds() -> np.ndarray:
    """Lower-case letters and bytes of other scripts stand for themselves, all else for a blank."""
    kinds = np.full(256, 32, np.uint32)
    kinds[97:123] = np.arange(97, 123)
    kinds[128:] = np.arange(128, 256)
    return kinds


KINDS = byte_kinds()


def features(texts: list[str]) -> np.ndarray:
    """A unit row for each text: square roots of the counts of hashed bigrams and trigrams."""
    raw = [b"  " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(len(raw) * DIM)
    for at in range(0, len(data), STEP):  # grams that start in this step
        codes = KINDS[data[at : at + STEP + 2]]
        row = np.repeat(np.arange(len(raw)), np.diff(np.clip(bounds, at, at + len(codes))))
        two = codes[:-1] * np.uint32(257) + codes[1:]
        three = two[:-1] * np.uint32(257) + codes[2:]
        for gram, width in ((two[:STEP], 2), (three[:STEP], 3)):
            bucket = (gram * np.uint32(2654435761) + np.uint32(width * 40503)) >> np.uint32(32 - DIM.bit_length() + 1)
            first = row[: len(gram)]
            real = (gram != 32 * 257 + 32 if width == 2 else gram != (32 * 257 + 32) * 257 + 32) & (row[width - 1 : width - 1 + len(gram)] == first)
            out += np.bincount(first[real] * DIM + bucket[real], minlength=len(out))
    out = np.sqrt(out.reshape(len(raw), DIM))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 8.0, passes: int = 25, seed: int = 5) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    random = np.random.default_rng(seed)
    weight = {s: cost * len(y) / (2 * max(1, (y == s).sum())) for s in (1, -1)}
    ease = np.array([0.5 / weight[s] for s in y.tolist()])
    scale = (x * x).sum(1) + ease
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    for _ in range(passes):
        most = 0.0
        for i in random.permutation(len(y)).tolist():
            slope = y[i] * float(w @ x[i]) - 1 + ease[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / scale[i])
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to the chance of 1, with softened targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - goal) * margin).sum() + 1e-3 * (a - 1), (p - goal).sum() + 1e-3 * b])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -1, 1))
    return max(a, 1e-3), b


class Machine:
    """One linear machine with its sigmoid."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        part = np.arange(len(y)) % 5 == 0
        if len(set(y[part].tolist())) < 2 or len(set(y[~part].tolist())) < 2:
            part = np.ones(len(y), bool)
            self.w = svm(x, y)
        else:
            self.w = svm(x[~part], y[~part])
        self.a, self.b = sigmoid_fit(self.margin(x[part]), y[part])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -30, 30)))


class Model:
    """Families and their languages, with the machines that tell them apart."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        of = {code: family for family, codes in FAMILIES.items() for code in codes}
        self.languages = sorted(set(lang.tolist()))
        family = np.array([of.get(code, code) for code in lang.tolist()])
        self.families = sorted(set(family.tolist()))
        self.members = {f: sorted(set(lang[family == f].tolist())) for f in self.families}
        self.outer = {f: Machine(x, np.where(family == f, 1, -1)) for f in self.families} if len(self.families) > 1 else {}
        self.inner: dict[tuple[str, str], Machine] = {}
        for codes in self.members.values():
            for a, b in combinations(codes, 2):
                own = (lang == a) | (lang == b)
                self.inner[a, b] = Machine(x[own], np.where(lang[own] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if self.outer:
            chance = np.stack([self.outer[f].chance(x) for f in self.families], 1)
            best = np.stack([self.outer[f].margin(x) for f in self.families], 1).argmax(1)
            sure = chance[np.arange(len(x)), best] / np.maximum(chance.sum(1), 1e-9)
        else:
            best, sure = np.zeros(len(x), int), np.ones(len(x))
        said, score = np.empty(len(x), object), np.array(sure, float)
        for number, f in enumerate(self.families):
            own = np.flatnonzero(best == number)
            codes = self.members[f]
            votes, margins, near = (np.zeros((len(own), len(codes))) for _ in range(3))
            for i, j in combinations(range(len(codes)), 2):
                machine = self.inner[codes[i], codes[j]]
                margin, chance = machine.margin(x[own]), machine.chance(x[own])
                votes[:, i] += margin >= 0
                votes[:, j] += margin < 0
                margins[:, i] += margin
                margins[:, j] -= margin
                near[:, i] += chance
                near[:, j] += 1 - chance
            if not len(own):
                continue
            first = np.lexsort((-margins, -votes), axis=1)[:, 0] if len(codes) > 1 else np.zeros(len(own), int)
            said[own] = np.array(codes, object)[first]
            if len(codes) > 1:
                score[own] *= near[np.arange(len(own)), first] / (len(codes) - 1)
        return said.tolist(), np.clip(score, 0, 1)


def sample(docs: DataFrame, learn: Column, most: int = SAMPLE, most_all: int = SAMPLE_ALL) -> tuple[np.ndarray, np.ndarray]:
    """Features and languages of the labelled rows to learn from, a bounded number, in the order of the identifiers."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_all // 8).collect()}
    if not counts:
        return np.zeros((0, DIM), np.float32), np.zeros(0, object)
    each = min(most, most_all // len(counts))
    share = F.lit(0.0)
    for code, n in counts.items():
        share = F.when(F.col("lang") == code, F.lit(min(1.0, each / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1 << 30)) / float(1 << 30)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("x", pa.binary())])

    def work(batch):
        ids, texts, langs = (batch.column(i).to_pylist() for i in range(3))
        own = [i for i, t in enumerate(texts) if has_letter(t)]
        for form in (lambda t: t, lambda t: " ".join(t.split(None, SHORT)[:SHORT])):
            x = features([form(texts[i]) for i in own])
            yield {"doc_id": [ids[i] for i in own], "lang": [langs[i] for i in own], "x": [r.astype(np.float16).tobytes() for r in x]}

    found = rows.where(place < share).mapInArrow(in_batches(work, schema), "doc_id long, lang string, x binary").toPandas()
    found = found.sort_values(["doc_id", "lang"], kind="stable")
    x = np.frombuffer(b"".join(found["x"]), np.float16).reshape(-1, DIM).astype(np.float32)
    return x, found["lang"].to_numpy(object)


def predictor(model: Model | None):
    """A function from texts to their languages and scores."""

    def run(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        said, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for a in range(0, len(texts), 64):
            told = [i for i in range(a, min(a + 64, len(texts))) if model and has_letter(texts[i])]
            if told:
                names, sure = model.predict(features([texts[i] for i in told]))
                score[told] = sure
                for i, name in zip(told, names):
                    said[i] = name
        return said, score

    return run


def fit(docs: DataFrame, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The machines of the labelled rows that are not held out."""
    own = clean_id(docs, id_col, text_col, lang_col).select("doc_id", F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    x, lang = sample(own, ~(held_out(F.col("doc_id")) if held is None else held))
    return Model(x, lang) if len(lang) else None


def identify(docs: DataFrame, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    held = held_out(F.col("doc_id")) if held is None else held
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, held, id_col, text_col, lang_col))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def work(batch):
        said, score = predictor(shared.value)(batch.column(2).to_pylist())
        yield {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": said, "score": pa.array(score)}

    own = clean_id(docs, id_col, text_col).select("doc_id", held.alias("held_out"), text_col)
    return own.mapInArrow(in_batches(work, schema), "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is told, with all their columns; a null language becomes the one told."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, None, id_col, text_col, lang_col))
    names = docs.columns
    text, lang = names.index(text_col), names.index(lang_col)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                said = pa.array(predictor(shared.value)(piece.column(text).to_pylist())[0])
                filled = pc.coalesce(piece.column(lang), said)
                columns = [filled if i == lang else piece.column(i) for i in range(piece.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pc.not_equal(said, UNKNOWN))

    return docs.mapInArrow(released(run), docs.schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return identify(table(spark, sf_dir, "documents"))
