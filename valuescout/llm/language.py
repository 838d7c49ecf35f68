"""Language identification with error-correcting output codes.

Each language gets a codeword of bits. One binary classifier per bit tells,
from hashed letter n-grams, the languages with a 1 from those with a 0. A text
is decoded to the codeword with the least loss; each classifier's loss counts
by how often it was right on that language in training (loss-weighted
decoding). A close second marks the text as ambiguous.

Training reads all labelled rows: Spark sums n-gram counts by language, so the
driver sees one row of counts per language, however large the corpus.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from valuescout.llm.names import blocks, lazily, tidily

UNDETERMINED = "und"
FEATURES = 1 << 13
MAX_LANGUAGES = 512
MARGIN = 0.05
_SMOOTHING = 0.5
_SCALE = 6.0
# Weights are whole 65536ths: sums of counts times weights stay below 2**53, so
# they are exact whatever the order, and a text's score is its own.
_FIXED = 1 << 16
_LETTER = re.compile(r"[^\W\d_]")
_CELLS = 1 << 20


def _letters():
    """Letters as they are, A to Z in lower case, all else as a space."""
    table = np.full(256, 32, np.uint32)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_FOLD = _letters()


def _counts(raw, features):
    """Rows of hashed counts of 2- and 3-grams of letters and word edges."""
    out = np.zeros((len(raw), features))
    length = np.array([len(r) + 2 for r in raw])
    data = _FOLD[np.frombuffer(b"".join(b" " + r + b" " for r in raw), np.uint8)]
    text = np.repeat(np.arange(len(raw)), length)
    edge = np.cumsum(length)
    for size in (2, 3):
        n = len(data) - size + 1
        if n < 1:
            continue
        gram = np.zeros(n, np.uint32)
        seen = np.zeros(n, bool)
        for i in range(size):
            part = data[i : i + n]
            gram = gram * np.uint32(257) + part
            seen |= part != 32
        gram = (gram + np.uint32(size)) * np.uint32(2654435761)
        cell = (gram >> np.uint32(32 - features.bit_length() + 1)).astype(np.int64)
        use = seen & (np.arange(n) + size <= edge[text[:n]])
        flat = np.bincount(text[:n][use] * features + cell[use], minlength=out.size)
        out += flat.reshape(out.shape)
    return out


def _counted(batches, features):
    """Blocks of row numbers in a batch with their counts."""
    rows = max(1, _CELLS // features)
    for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
        for some, raw in blocks(range(batch.num_rows), lazily(batch["text"])):
            yield batch, some, raw, _counts(raw, features)


@tidily
def _sums(batches, features):
    for batch, some, _, counts in _counted(batches, features):
        lang = np.array(batch["lang"].to_pylist(), object)[list(some)]
        for name in sorted(set(lang)):
            summed = counts[lang == name].sum(axis=0)
            cells = np.flatnonzero(summed)
            names = pa.array([name] * len(cells), pa.string())
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(cells.astype(np.int32)), pa.array(summed[cells].astype(np.int64))], ["lang", "cell", "n"]
            )


def codewords(count):
    """Distinct codewords, one row of +1 and -1 per language.

    Up to five languages get all possible splits, more get the best of some
    fixed random codes by the least distance of two rows.
    """
    if count < 2:
        return np.zeros((count, 0))
    if count <= 5:
        splits = [[(i >> lang) & 1 for lang in range(count)] for i in range(1, 1 << (count - 1))]
        return np.array(splits, float).T * 2 - 1
    bits = int(np.ceil(10 * np.log2(count)))
    rng = np.random.Generator(np.random.PCG64(3))
    best, distance = None, -1
    while distance < 1:
        for _ in range(50):
            code = rng.integers(0, 2, (count, bits)) * 2.0 - 1
            mixed_columns = np.abs(code.sum(axis=0)) < count
            code[:, ~mixed_columns] *= np.where(np.arange(count) % 2, 1, -1)[:, None]
            least = ((bits - code @ code.T) / 2 + bits * np.eye(count)).min()
            if least > distance:
                best, distance = code, least
    return best


class Model:
    """Weights of the bit classifiers, codewords and their decoding weights."""

    def __init__(self, languages, code, weights, trust):
        self.languages, self.code, self.weights, self.trust = languages, code, weights, trust

    def margins(self, counts):
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return _SCALE * (counts @ self.weights) / (total * _FIXED)

    def decode(self, margins):
        """Probability-like score per language, from weighted logistic loss."""
        loss = np.zeros((len(margins), len(self.languages)))
        for margin, word, trust in zip(margins.T, self.code.T, self.trust.T):
            loss += np.logaddexp(0, -margin[:, None] * word) * trust
        shifted = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return shifted / shifted.sum(axis=1, keepdims=True)


@tidily
def _right(batches, model, features):
    place = {lang: i for i, lang in enumerate(model.languages)}
    for batch, some, _, counts in _counted(batches, features):
        lang = batch["lang"].to_pylist()
        row = np.array([place[lang[i]] for i in some])
        hit = (model.margins(counts) * model.code[row] > 0).astype(np.int64)
        sums = np.zeros((len(model.languages), hit.shape[1] + 1), np.int64)
        np.add.at(sums, row, np.concatenate([hit, np.ones((len(row), 1), np.int64)], axis=1))
        used = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["row", "hits"])


def fit_languages(labelled: DataFrame, text_col="text", lang_col="lang", features=FEATURES) -> Model:
    """Fit on all rows with a label; reads them twice, collects counts only.

    Rows with a null label or text are left out. What reaches the driver is
    bounded by MAX_LANGUAGES times `features` counts; more languages are an
    error.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    summed = rows.mapInArrow(lambda b: _sums(b, features), "lang string, cell int, n long")
    summed = summed.groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = summed.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    found = found.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in found]
    share = np.zeros((len(found), features))
    for row, r in zip(share, found):
        row[[c["cell"] for c in r["cells"]]] = [c["n"] for c in r["cells"]]
    share = share + _SMOOTHING
    share /= share.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((features, code.shape[1]))
    for bit in range(code.shape[1]):
        one = code[:, bit] > 0
        weights[:, bit] = np.rint(_FIXED * (np.log(share[one].mean(axis=0)) - np.log(share[~one].mean(axis=0))))
    model = Model(languages, code, weights, np.ones(code.shape))
    if not code.size:
        return model
    hits = rows.mapInArrow(lambda b: _right(b, model, features), "row int, hits array<long>")
    sums = [F.sum(F.col("hits")[i]).alias(f"h{i}") for i in range(code.shape[1] + 1)]
    trust = np.zeros(code.shape)
    for r in hits.groupBy("row").agg(*sums).collect():
        values = np.array(r[1:], float)
        trust[r["row"]] = (values[:-1] + 1) / (values[-1] + 2)
    model.trust = trust / trust.sum(axis=1, keepdims=True) * code.shape[1]
    return model


@tidily
def _predicted(batches, model, features, margin, schema):
    rows = max(1, _CELLS // features)
    for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
        texts = batch["text"].to_pylist()
        known = [t is not None and _LETTER.search(t) is not None for t in texts]
        pred, score, unsure = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
        for _, some, _, counts in _counted([batch], features):
            if not model.languages:
                continue
            chance = model.decode(model.margins(counts))
            best = chance.argmax(axis=1)
            ranked = np.sort(chance, axis=1)
            gap = ranked[:, -1] - (ranked[:, -2] if len(model.languages) > 1 else 0)
            for i, b, s, g in zip(some, best, ranked[:, -1], gap):
                if known[i]:
                    pred[i], score[i], unsure[i] = model.languages[b], float(s), bool(g < margin)
        more = {"lang_pred": pa.array(pred), "score": pa.array(score), "ambiguous": pa.array(unsure)}
        yield pa.RecordBatch.from_arrays([more[f.name] if f.name in more else batch[f.name] for f in schema], schema=schema)


def identify_languages(docs: DataFrame, model: Model, text_col="text", carry=(), margin=MARGIN, features=FEATURES) -> DataFrame:
    """Predict each whole text's language, row by row, without a shuffle.

    Returns text, rest (a struct of the columns named in `carry`), lang_pred,
    score (0 to 1) and ambiguous (the runner-up is closer than `margin`).

    Defined cases: a null text or one without a letter is `und` with score 0
    and ambiguous; a model without languages calls everything `und`; with one
    language every text with a letter is that one, score 1; equal texts get
    equal answers, whatever texts they are read with; very long texts are
    counted whole; an empty table gives an empty result; columns not named are
    ignored, whatever they are called.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rest = F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("rest")
    rows = docs.select(F.col(text_col).cast("string").alias("text"), rest)
    out = rows.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "ambiguous": F.lit(True)}).schema
    for field in out.fields:
        field.nullable = True
    schema = to_arrow_schema(out)
    return rows.mapInArrow(lambda b: _predicted(b, model, features, margin, schema), out)


def held_out(id_col="doc_id"):
    """A quarter of the ids, by a hash; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.filter(~held_out()))
    found = identify_languages(docs.select("text", F.col("doc_id"), held_out().alias("held_out")), model, carry=("doc_id", "held_out"))
    return found.select("rest.doc_id", "rest.held_out", "lang_pred", "score", "ambiguous")


def brute_force(labelled, texts, features=FEATURES):
    """The same text by text with dictionaries, for small tables in tests.

    `labelled` are (text, lang), `texts` the texts to predict. Returns
    (lang_pred, score) of each.
    """
    import math

    def grams(text):
        data = "".join(chr(b) if b > 127 or chr(b).isalpha() else " " for b in text.encode())
        data = " " + data.translate({c: c + 32 for c in range(65, 91)}) + " "
        found = {}
        for size in (2, 3):
            for at in range(len(data) - size + 1):
                if data[at : at + size].strip(" "):
                    value = 0
                    for c in data[at : at + size]:
                        value = value * 257 + ord(c)
                    cell = ((value + size) * 2654435761 % (1 << 32)) >> (33 - features.bit_length())
                    found[cell] = found.get(cell, 0) + 1
        return found

    rows = [(grams(text), lang) for text, lang in labelled if text is not None and lang is not None]
    languages = sorted({lang for _, lang in rows})
    code = codewords(len(languages)).tolist()
    bits = range(len(code[0]) if code else 0)
    totals = {lang: [_SMOOTHING] * features for lang in languages}
    for found, lang in rows:
        for cell, n in found.items():
            totals[lang][cell] += n
    sums = {lang: math.fsum(totals[lang]) for lang in languages}

    def weight(cell, bit):
        sides = [[totals[lang][cell] / sums[lang] for lang, word in zip(languages, code) if (word[bit] > 0) == one] for one in (True, False)]
        return round(_FIXED * math.log(math.fsum(sides[0]) / len(sides[0]) / (math.fsum(sides[1]) / len(sides[1]))))

    known = {}

    def margins(found):
        out = []
        for bit in bits:
            for cell in found:
                if (cell, bit) not in known:
                    known[cell, bit] = weight(cell, bit)
            out.append(_SCALE * sum(n * known[cell, bit] for cell, n in found.items()) / (_FIXED * max(1, sum(found.values()))))
        return out

    right = {lang: [1] * len(bits) for lang in languages}
    have = {lang: 2 for lang in languages}
    for found, lang in rows:
        have[lang] += 1
        for bit, m in enumerate(margins(found)):
            right[lang][bit] += m * code[languages.index(lang)][bit] > 0
    out = []
    for text in texts:
        if text is None or not languages or not _LETTER.search(text):
            out.append((UNDETERMINED, 0.0))
            continue
        m, loss = margins(grams(text)), []
        for lang, word in zip(languages, code):
            trust = [r / have[lang] for r in right[lang]]
            trust = [t * len(trust) / math.fsum(trust) for t in trust]
            loss.append(math.fsum(math.log1p(math.exp(-a * b)) * t for a, b, t in zip(m, word, trust)))
        share = [math.exp(min(loss) - x) for x in loss]
        best = loss.index(min(loss))
        out.append((languages[best], share[best] / math.fsum(share)))
    return out
