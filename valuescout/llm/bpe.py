"""BPE encoding and decoding, with long texts encoded in pieces.

Tree concatenation: a long text is halved until its pieces are short, all
pieces of all texts are encoded in parallel, and neighbours are joined pair by
pair. At a join the tokens may differ from those of the whole: a window
around it is encoded anew and grows until its outermost tokens are those that
both sides had there already. Whatever lies beyond is then right as it is.

Why a window may stop: of a pre-token's BPE encoding, every stretch between
two of its token borders is the encoding of that stretch alone, and a token
sequence is the encoding of its text if each two neighbours are. Where the
kind of characters changes, pre-tokens end whatever stands around, so windows
that would leave a run of one kind go on to the next such border instead.
"""

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from valuescout.llm.names import tidily

PIECE = 1 << 14
SLICE = 256
WINDOW = 16

# fixed value: how the vocabulary's texts are cut before merging
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_KINDS = regex.compile(r"(\p{L})|(\p{N})|(\s)")
_RUN = {k: regex.compile(p) for k, p in {1: r"\p{L}*", 2: r"\p{N}*", 3: r"\s*", 4: r"[^\s\p{L}\p{N}]*"}.items()}
_BACK = {k: regex.compile("(?r)" + p.pattern) for k, p in _RUN.items()}


def _byte_letters():
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, definition):
        import tiktoken

        data = json.loads(definition)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocabulary = {k: v for k, v in data["model"]["vocab"].items() if k not in self.special}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
        self._core = tiktoken.Encoding("vocabulary", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        size = 1 + max([*ranks.values(), *self.special.values()])
        self.bytes = [b""] * size
        for token, i in ranks.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self._cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def plain(self, text):
        """Ids of a text taken as ordinary characters."""
        return self._core.encode_ordinary(text)

    def decode(self, ids):
        return b"".join([self.bytes[i] for i in ids]).decode(errors="replace")

    def segments(self, text):
        """Ordinary stretches of the text and ids of special tokens, in order."""
        at = 0
        for found in self._cut.finditer(text) if self._cut else ():
            if found.start() > at:
                yield text[at : found.start()]
            yield self.special[found[0]]
            at = found.end()
        if at < len(text):
            yield text[at:]

    def encode(self, text):
        """Ids of a text that is short enough to be encoded in one go."""
        if self._cut is None or not self._cut.search(text):
            return self.plain(text)
        ids = []
        for part in self.segments(text):
            ids += [part] if isinstance(part, int) else self.plain(part)
        return ids


class _Kept(dict):
    """A cache that travels to tasks empty."""

    def __reduce__(self):
        return _Kept, ()


_CODECS = _Kept()


def _codec(definition):
    if definition not in _CODECS:
        _CODECS[definition] = Codec(definition)
    return _CODECS[definition]


def _kind(char):
    found = _KINDS.match(char)
    return found.lastindex if found else 4


def _border(text, at):
    """Whether a pre-token ends at this place whatever stands further off."""
    if at <= 0 or at >= len(text):
        return True
    before, after = _kind(text[at - 1]), _kind(text[at])
    return before != after and before != 3 and text[at - 1] != "'"


def _run(text, at):
    """The run of characters of one kind around a place, or nothing."""
    kind = _kind(text[at - 1])
    if kind != _kind(text[at]):
        return at, at
    start = _BACK[kind].match(text, endpos=at, pos=0).start()
    stop = _RUN[kind].match(text, at).end()
    # the last space joins the word after it
    return start, stop - (kind == 3 and stop < len(text))


def _outside(text, at):
    """The nearest certain borders on both sides of a place."""
    left, right = at, at
    while not _border(text, left):
        kind = _kind(text[left - 1])
        left = _BACK[kind].match(text, endpos=left, pos=0).start()
    while not _border(text, right):
        kind = _kind(text[right])
        right = _RUN[kind].match(text, right).end()
    return left, right


def _back_to(codec, ids, length):
    """How many last tokens make up at least `length` bytes, and how many bytes."""
    count = size = 0
    while size < length and count < len(ids):
        count += 1
        size += len(codec.bytes[ids[-count]])
    return count, size


def _on_to(codec, ids, length):
    count = size = 0
    while size < length and count < len(ids):
        size += len(codec.bytes[ids[count]])
        count += 1
    return count, size


def join(codec, left_text, left, right_text, right):
    """Tokens of two neighbouring texts as one, from the tokens of each."""
    if not left or not right:
        return left + right
    text, at = left_text + right_text, len(left_text)
    if _border(text, at):
        return left + right
    start, stop = _run(text, at)
    window = WINDOW
    while True:
        window = min(window, len(left)), min(window, len(right))
        taken = [sum(len(codec.bytes[i]) for i in part) for part in (left[len(left) - window[0] :], right[: window[1]])]
        near = left_text.encode()[-taken[0] :], right_text.encode()[: taken[1]]
        try:
            near = [x.decode() for x in near]
        except UnicodeDecodeError:  # a token ends inside a character
            near = None
        if near and start <= at - len(near[0]) and at + len(near[1]) <= stop:
            anew = codec.plain(near[0] + near[1])
            if anew[0] == left[-window[0]] and anew[-1] == right[window[1] - 1]:
                return left[: len(left) - window[0]] + anew + right[window[1] :]
        elif near:
            break
        if window == (len(left), len(right)):
            break
        window = 2 * max(window)
    # the window leaves the run: go on to borders that hold in any case
    begin, end = _outside(text, at)
    if begin == 0 and end == len(text):
        return codec.plain(text)
    keep, size = len(left), 0
    wanted = len(left_text[begin:].encode())
    dropped, size = _back_to(codec, left, wanted)
    used, length = _on_to(codec, right, len(right_text[: end - at].encode()))
    return left[: keep - dropped] + codec.plain(text[begin:end]) + right[used:]


def pieces(codec, text, size=PIECE):
    """Halves of halves of the ordinary stretches; special tokens as ids.

    Returns (stretch, piece) in order: all pieces of one stretch are to be
    joined, stretches and special tokens just follow each other.
    """
    out = []

    def halve(number, part):
        if len(part) <= size:
            out.append((number, part))
        else:
            halve(number, part[: len(part) // 2])
            halve(number, part[len(part) // 2 :])

    for number, part in enumerate(codec.segments(text)):
        out.append((number, part)) if isinstance(part, int) else halve(number, part)
    return out


def concatenated(codec, parts):
    """Join the encoded pieces of one stretch pair by pair, level by level."""
    while len(parts) > 1:
        pairs = [
            (a[0] + b[0], join(codec, a[0], a[1], b[0], b[1])) for a, b in zip(parts[::2], parts[1::2])
        ]
        parts = pairs + parts[len(parts) - len(parts) % 2 :]
    return parts[0][1]


def _row_slices(batches):
    return (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))


@tidily
def _cut_pieces(batches, codec_bytes, size, schema):
    """Pieces of long texts; the first one of a text carries its `rest`."""
    for batch in _row_slices(batches):
        codec = _codec(codec_bytes)
        row, rows = [], {"piece": [], "stretch": [], "special": [], "text": []}
        for number, text in enumerate(batch["text"].to_pylist()):
            for n, (stretch, part) in enumerate(pieces(codec, text, size)):
                special = isinstance(part, int)
                row.append(number)
                for name, value in zip(rows, (n, stretch, part if special else None, None if special else part)):
                    rows[name].append(value)
        first = pa.array([r if n == 0 else None for r, n in zip(row, rows["piece"])], pa.int32())
        made = {k: pa.array(v, schema.field(k).type) for k, v in rows.items()} | {"rest": batch["rest"].take(first)}
        columns = [made[f.name] if f.name in made else batch[f.name].take(pa.array(row, pa.int32())) for f in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _lists(ids):
    edges = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(edges[-1]))
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))


@tidily
def _encoded_pieces(batches, codec_bytes, schema):
    for batch in _row_slices(batches):
        codec = _codec(codec_bytes)
        ids = [codec.plain(t) if t is not None else [s] for t, s in zip(batch["text"].to_pylist(), batch["special"].to_pylist())]
        columns = [_lists(ids) if f.name == "ids" else batch[f.name] for f in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _finished(batch, codec, ids, exact, schema):
    more = {"ids": _lists(ids)}
    texts = [codec.decode(x) for x in ids]
    more["exact"] = pa.array([exact(i, t) for i, t in enumerate(texts)], pa.bool_())
    if "decoded" in schema.names:
        more["decoded"] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_arrays([more[f.name] if f.name in more else batch[f.name] for f in schema], schema=schema)


@tidily
def _joined(batches, codec_bytes, schema):
    """Join the pieces of each text; a piece's text is that of its ids."""
    for batch in _row_slices(batches):
        codec = _codec(codec_bytes)
        out = []
        for parts in batch["parts"]:
            parts = sorted(parts.as_py(), key=lambda p: p["piece"])
            ids, at = [], 0
            while at < len(parts):
                stop = at
                while stop < len(parts) and parts[stop]["stretch"] == parts[at]["stretch"]:
                    stop += 1
                ids += concatenated(codec, [(codec.decode(p["ids"]), p["ids"]) for p in parts[at:stop]])
                at = stop
            out.append(ids)
        keys = batch["key"].to_pylist()
        yield _finished(batch, codec, out, lambda i, t: hashlib.sha256(t.encode()).hexdigest() == keys[i], schema)


@tidily
def _whole(batches, codec_bytes, schema):
    """Encode the texts that are short."""
    for batch in _row_slices(batches):
        codec = _codec(codec_bytes)
        texts = batch["text"].to_pylist()
        yield _finished(batch, codec, [codec.encode(t) for t in texts], lambda i, t: t == texts[i], schema)


def encode_texts(
    docs: DataFrame, vocabulary, id_col="doc_id", text_col="text", carry=(), size=PIECE, decoded=True
) -> DataFrame:
    """Encode whole texts with a byte-level BPE vocabulary and decode them.

    `vocabulary` is the path of a tokenizers definition, read once on the
    driver; its content travels with the tasks. Texts of at most `size`
    characters are encoded where they lie; only the others' pieces are
    shuffled, first to spread them, then, as ids, to bring each text's pieces
    together. Equal rows are encoded once and come back as often.

    Returns id, rest (a struct of the columns named in `carry`), ids (array of
    int), exact (whether the ids decode to the text) and, unless switched off,
    decoded (the text of those ids).

    Defined cases: a null or empty text has no ids; special tokens found in a
    text become their ids; equal texts get equal ids, repeated rows included;
    very long texts are cut into pieces and come back as one; an empty table
    gives an empty result; columns not named are ignored, whatever they are
    called.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(vocabulary, "rb") as file:
        definition = file.read()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("rest"),
        text.alias("text"),
    )
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "rest")}

    def schema_of(**columns):
        ddl = ", ".join(f"{name} {kind}" for name, kind in columns.items())
        return ddl, to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)

    # what tells rows apart, besides their id: the text and all that is carried
    own = {"id": kinds["id"], "same": "string", "key": "string"}
    same = F.md5(F.to_json("rest").cast("binary"))
    long_rows = rows.filter(F.length("text") > size).withColumns({"same": same, "key": F.sha2(F.col("text").cast("binary"), 256)})
    ddl, cut_schema = schema_of(**own, rest=kinds["rest"], piece="int", stretch="int", special="int", text="string")
    cut = long_rows.mapInArrow(lambda b: _cut_pieces(b, definition, size, cut_schema), ddl)
    first = [F.first(c).alias(c) for c in ("rest", "stretch", "special", "text")]
    cut = cut.groupBy(*own, "piece").agg(*first, F.count(F.lit(1)).alias("copies"))  # also deals the pieces out
    ddl, piece_schema = schema_of(**own, rest=kinds["rest"], piece="int", stretch="int", copies="long", ids="array<int>")
    done = cut.mapInArrow(lambda b: _encoded_pieces(b, definition, piece_schema), ddl)
    together = done.groupBy(*own).agg(
        F.collect_list(F.struct("piece", "stretch", "ids")).alias("parts"),
        F.first("rest", ignorenulls=True).alias("rest"),
        F.max("copies").alias("copies"),
    )
    result = {**kinds, "ids": "array<int>", "exact": "boolean"} | ({"decoded": "string"} if decoded else {})
    ddl, joined_schema = schema_of(**result, copies="long")
    joined = together.mapInArrow(lambda b: _joined(b, definition, joined_schema), ddl)
    joined = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*result)
    ddl, short_schema = schema_of(**result)
    short = rows.filter(F.length("text") <= size).mapInArrow(lambda b: _whole(b, definition, short_schema), ddl)
    return short.union(joined)


def default_vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = encode_texts(docs, default_vocabulary())
    return done.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
