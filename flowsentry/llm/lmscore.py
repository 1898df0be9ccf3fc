"""Language-model scores: how probable every whole text is after the training texts, in bits per byte.

A text is its lower-cased (A-Z) words and an end. The most frequent words (VOCABULARY, seen twice at least), the end and
an escape have a prefix code by their numbers in training; all other words are an escape and their letters, eight
bits each. So a text is a string of bits that gives it back whole, and all of its bits are coded by online logistic
context mixing (`contextmix`). Tables for the bits of a code: the exact numbers in training, and two hashed from the word
before and from the cells (last two letters and first) of the two words before, which all training texts fill. For
those of a letter: hashed from the one, two or three letters before, filled by all distinct training words.
So every text has a probability, and all texts together at most one.

Words are counted in slices of the input; a slice keeps its texts as numbers of its own words and asks the table of all
counts for those once. That table grows with the corpus and is only joined. What is broadcast has a fixed size
(5 * SLOTS log-odds, VOCABULARY words and their code). Adaptation restarts every SEGMENT words, so that long texts are coded side
by side; contexts reach across. A text's score depends on no other text that is scored.

Defined results: null and empty texts are an end alone. A null id is held out. Rows repeated under one id are each
scored, and each teaches. Without training rows the counts are 0, the base score 0 and all tables say one half. An
empty table gives an empty result. Other columns of the input are never looked at.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.batches import chunks
from flowsentry.llm.contextmix import NODES, PLACES, SLOTS, WEIGHTS, code_of, code_slots, log_odds, online_mix
from flowsentry.llm.words import encoded, mixed
from flowsentry.session import checkpointed

FOLDS, HELD_OUT = 7, 2
SLICE_BYTES = 4 << 20
SEGMENT = 512
VOCABULARY, MANY = 1 << 17, 1 << 20  # words with a code at most; numbers of words beyond are alike in choosing them
END, ESCAPE = 0, 1
PART = 500_000  # tokens whose bits are held at a time
BATCH, GATHERED = 20_000, 500_000
CODE_WEIGHTS = (0.35, 0.3, 0.35)
_SPACE, _LETTER = 32, 1 << 30


def cell_of(word: bytes) -> int:
    """1 to 255 from a word's last two bytes and its first; 0 is the end's."""
    return max(1, (zlib.crc32(word[-2:]) & 15) << 4 | word[0] & 15) if word else 0


def held_out(id_column: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def token_contexts(cells: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every token: the cell before, and the hashed context of two cells before. `first` marks tokens that begin a text."""
    one = np.where(first, 0, np.concatenate([[0], cells[:-1]]))
    two = np.where(first, 0, np.concatenate([[0], one[:-1]]))
    return one, mixed(257 + one * 256 + two)


def letter_contexts(words: list[bytes], cells: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The letters of all words, each word with a space at its end, their hashed contexts, and where words begin."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    cell = np.repeat(cells, sizes)
    letters, one = data[1:], data[:-1]
    two = np.where(one == _SPACE, _SPACE, np.concatenate([[_SPACE], one[:-1]]))
    three = np.where(two == _SPACE, _SPACE, np.concatenate([[_SPACE], two[:-1]]))
    contexts = [mixed(cell << 8 | one), mixed((1 << 17) + (two << 8 | one) * 16 + (cell >> 4)), mixed((1 << 25) + (three << 16 | two << 8 | one))]
    return letters, contexts, np.cumsum(sizes) - sizes


def before(key: np.ndarray) -> np.ndarray:
    """How many earlier elements are equal."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return out


def distinct_before(key: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many earlier elements are equal, and how many of those are marked as new."""
    order = np.argsort(key, kind="stable")
    ranked, marks = key[order], new[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(first, len(key)))
    running = np.cumsum(marks) - marks
    every, out = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    every[order] = np.arange(len(key)) - np.repeat(first, sizes)
    out[order] = running - np.repeat(running[first], sizes)
    return every, out


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begin to begin + size of all ranges, one after the other."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def word_contexts(words: list[bytes], tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every token: a hash of the cell before, and of the two cells before."""
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(sizes) - sizes] = True
    one, two = token_contexts(np.array([cell_of(w) for w in words], np.int64)[tokens], first)
    return _short(mixed(one)), _short(two)


def _short(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(32)).astype(np.uint32)


def letter_bits(words: list[bytes], code: Code) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of the bits of all words' letters: what the code asks, how deep, and the hashed contexts; and how many bits each word has."""
    letters, contexts, begin = letter_contexts(words, np.zeros(len(words), np.int64))
    letters = letters[:int(sum(len(w) + 1 for w in words))]
    length = code.sizes[letters]
    bits = ranges(code.begin[letters], length)
    depth = bits - np.repeat(code.begin[letters], length)
    return code.path[bits], depth, [np.repeat(_short(c), length) for c in contexts], np.add.reduceat(length, begin)


class Code:
    """A prefix code of symbols by their weights; `words` are those of the vocabulary, after the end and the escape."""

    def __init__(self, weights: np.ndarray, words: list[bytes] = ()):
        self.known = {w: i for i, w in enumerate(words, 2)}
        self.sizes, self.begin, self.path, self.counts = code_of(weights)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.known.get(w, ESCAPE) if w else END for w in words], np.int64)


@dataclass
class MixModel:
    """The codes of words and letters, and log-odds of bits: of words by themselves, after one and after two, and of letters."""

    code: Code
    spelling: Code
    alone: np.ndarray
    after_one: np.ndarray
    after_two: np.ndarray
    letters: np.ndarray
    total: int
    distinct: int

    def log10(self, words: list[bytes], tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log10 probability of every text; tokens are numbers of words, text after text."""
        one, two = word_contexts(words, tokens, sizes)
        symbols, begin = self.code.symbols(words), np.cumsum(sizes) - sizes
        lanes = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start, size = begin[owner] + nth * SEGMENT, np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
        cuts = np.flatnonzero(np.diff(start // PART, prepend=-1)).tolist()
        sums = np.empty(len(owner))
        for a, b in zip(cuts, [*cuts[1:], len(owner)]):
            part = slice(start[a], start[b - 1] + size[b - 1])
            sums[a:b] = self._lanes(words, symbols, tokens[part], one[part], two[part], size[a:b])
        return np.bincount(owner, weights=sums, minlength=len(sizes)) / np.log(10)

    def _lanes(self, words, symbols, tokens, one, two, sizes) -> np.ndarray:
        """The log probability of lanes of tokens that follow each other."""
        kinds, tokens = np.unique(tokens, return_inverse=True)
        symbols = symbols[kinds]
        spelt = np.flatnonzero(symbols == ESCAPE)
        length = self.code.sizes[symbols]
        bits, letters = length.copy(), []
        for low in range(0, len(spelt), BATCH):
            letters.append(letter_bits([words[i] for i in kinds[spelt[low:low + BATCH]].tolist()], self.spelling))
            bits[spelt[low:low + BATCH]] += letters[-1][3]
        begin = np.cumsum(bits) - bits
        # the bits of every word, what the tables say of letters, and in one number: the node of a code (more than any in
        # letters), the node in the lane's own predictor, place and bit
        many = int(bits.sum())
        packed, by_table = np.empty(many, np.int64), np.empty((many, 3), np.float32)
        at, asked = ranges(begin, length), self.code.path[ranges(self.code.begin[symbols], length)]
        place, node = np.minimum((at - np.repeat(begin, length)) >> 1, 7), (asked >> 1).astype(np.int64)
        packed[at] = ((node * NODES | node * 0x9E37 >> 4 & NODES - 1) * PLACES | place) * 2 | asked & 1
        by_table[at, 0] = self.alone[node]
        for k, (asked, depth, contexts, size) in enumerate(letters):
            some = spelt[k * BATCH:(k + 1) * BATCH]
            at = ranges(begin[some] + length[some], size)
            packed[at] = ((_LETTER * NODES | (asked >> 1).astype(np.int64)) * PLACES | 8 + np.minimum(depth, 7)) * 2 | asked & 1
            for i, context in enumerate(contexts):
                by_table[at, i] = self.letters[i].take(code_slots(context, asked >> 1))
        letters.clear()
        token_bits = bits[tokens]
        of_word = ranges(begin[tokens], token_bits).astype(np.int32)
        of_token = np.repeat(np.arange(len(tokens), dtype=np.int32), token_bits)
        edges = np.concatenate([[0], np.cumsum(token_bits)])
        ends = np.cumsum(sizes)

        def look(number):
            own = of_word.take(number)
            inputs, known = by_table.take(own, axis=0), packed.take(own)
            asked = known // (2 * PLACES * NODES)
            coded = np.flatnonzero(asked < _LETTER)
            asked, token = asked.take(coded), of_token.take(number.take(coded))
            inputs[coded, 1] = self.after_one.take(code_slots(one.take(token), asked))
            inputs[coded, 2] = self.after_two.take(code_slots(two.take(token), asked))
            return inputs, known // (2 * PLACES) % NODES, known // 2 % PLACES, known & 1

        weights = np.repeat(np.array([CODE_WEIGHTS, WEIGHTS]), PLACES // 2, axis=0)
        return online_mix(look, weights, edges[ends - sizes], edges[ends] - edges[ends - sizes])


def _packed(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Whether texts are held out, their numbers of tokens and bytes, all tokens, and the slice's words."""
    many, raw = len(row["ids"]), zlib.decompress(row["texts"])
    held, sizes, lengths = (np.frombuffer(raw, np.int64, many, 8 * many * i) for i in range(3))
    tokens = np.frombuffer(raw, np.uint8, -1, 24 * many).reshape(4, -1).T.copy().view(np.int32)[:, 0].astype(np.int64)
    return held > 0, sizes, lengths, tokens, zlib.decompress(row["words"]).split(b" ")


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of tokens of every lower-cased text, all tokens (0 is an end, the others by falling frequency), and the words."""
    lists = [t.split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    found = pa.array([w for x in lists for w in x], pa.large_binary()).dictionary_encode()
    words, codes = found.dictionary.to_pylist(), found.indices.to_numpy()
    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(1, len(words) + 1)
    tokens = np.insert(rank[codes], np.cumsum(sizes), 0)
    return sizes + 1, tokens.astype(np.int32), [b"", *(words[i] for i in order.tolist())]


def token_slices(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Slices of the input: ids; the texts as numbers of the slice's own words, compressed; those words; and how often
    training rows have each."""
    rows = docs.select(F.col(id_column).alias("id"), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    kind = T.StructType([T.StructField("slice", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
                         *(T.StructField(c, T.BinaryType()) for c in ("texts", "words", "trained"))])

    def number(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, at = to_arrow_schema(kind), TaskContext.get().partitionId() << 32
        for part in _gathered(batches):
            texts = [encoded(t).lower() for t in part.column("text").to_pylist()]
            sizes, tokens, words = numbered(texts)
            lengths = np.array([len(t) for t in texts], np.int64)
            held = np.array(part.column("held_out").to_pylist(), np.int64)
            trained = np.bincount(tokens[np.repeat(held == 0, sizes)], minlength=len(words))
            planes = tokens.view(np.uint8).reshape(-1, 4).T.copy()  # bytes of a place together: the high ones are mostly 0
            values = [at, part.column("id").to_pylist(), _packed(held, sizes.astype(np.int64), lengths, planes),
                      zlib.compress(b" ".join(words), 1), _packed(trained.astype(np.int32))]
            at += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    return rows.mapInArrow(number, kind)


def _gathered(batches):
    """Record batches joined up to about SLICE_BYTES of text, longer ones cut."""
    waiting, held = [], 0
    for batch in batches:
        for part in chunks(batch, "text", SLICE_BYTES):
            waiting.append(part)
            held += part.column("text").nbytes
            if held >= SLICE_BYTES:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, held = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _table_rows(counts: np.ndarray) -> pa.RecordBatch:
    flat = counts.reshape(-1, 2)
    here = np.flatnonzero(flat.any(axis=1))
    return pa.RecordBatch.from_pydict({"slot": pa.array(here), "zeros": pa.array(flat[here, 0]), "ones": pa.array(flat[here, 1])})


_TABLE = "slot bigint, zeros bigint, ones bigint"


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The tables' sums over all tasks; at most `size` rows come to the driver."""
    found = parts.groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    out = np.zeros((size, 2), np.int64)
    out[found.column("slot").to_numpy()] = np.stack([found.column("zeros").to_numpy(), found.column("ones").to_numpy()], axis=1)
    return out


def vocabulary(counts: DataFrame) -> tuple[Code, int, int]:
    """The code, the number of training tokens and of distinct ones. Words of one number in training have a code together
    or not at all; what is left is the escape's."""
    found = counts.groupBy(F.least("n", F.lit(MANY)).alias("n")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")) \
        .orderBy(F.desc("n")).collect()
    total, distinct, least, held = sum(r.tokens for r in found), sum(r.words for r in found), MANY + 1, 0
    for row in found:
        held += row.words
        if held > VOCABULARY or row.n < 2:
            break
        least = row.n
    kept = counts.filter((F.least("n", F.lit(MANY)) >= least) | (F.length("word") == 0)).toArrow().sort_by([("word", "ascending")])
    numbers = dict(zip(kept.column("word").to_pylist(), kept.column("n").to_pylist()))
    ends = numbers.pop(b"", 0)
    rest = total - ends - sum(numbers.values())
    return Code(np.array([ends + 1, rest + 1, *numbers.values()], np.int64), list(numbers)), total, distinct


def fit_mix(slices: DataFrame, counts: DataFrame) -> MixModel:
    """Fill the tables from all training texts and all their words."""
    code, tokens_in_all, distinct = vocabulary(counts)
    spelling = Code(1 + np.bincount(np.frombuffer(b" ".join([*code.known, b""]), np.uint8), minlength=256))
    shared = slices.sparkSession.sparkContext.broadcast((code, spelling))

    def of_tokens(batches):
        total, known = np.zeros((2, SLOTS * 2), np.int64), shared.value[0]
        for batch in batches:
            for row in batch.select(["ids", "texts", "words"]).to_pylist():
                held, sizes, _, tokens, words = _unpacked(row)
                contexts, symbols = word_contexts(words, tokens, sizes), known.symbols(words)
                taught = np.flatnonzero(np.repeat(~held, sizes))
                for low in range(0, len(taught), PART):
                    some = taught[low:low + PART]
                    symbol = symbols[tokens[some]]
                    length = known.sizes[symbol]
                    asked = known.path[ranges(known.begin[symbol], length)]
                    node, bit = asked >> 1, (asked & 1).astype(np.uint32)
                    for table, context in zip(total, contexts):
                        table += np.bincount(code_slots(np.repeat(context[some], length), node) * 2 + bit, minlength=SLOTS * 2)
        yield _table_rows(total)

    def of_letters(batches):
        total, code = np.zeros((3, SLOTS * 2), np.int64), shared.value[1]
        for batch in batches:
            words = [w for w in batch.column("word").to_pylist() if w]
            if words:
                asked, _, contexts, _ = letter_bits(words, code)
                for table, context in zip(total, contexts):
                    table += np.bincount(code_slots(context, asked >> 1) * 2 + (asked & 1).astype(np.uint32), minlength=SLOTS * 2)
        yield _table_rows(total)

    tokens = _summed(slices.mapInArrow(of_tokens, _TABLE), 2 * SLOTS).reshape(2, SLOTS, 2)
    letters = _summed(counts.mapInArrow(of_letters, _TABLE), 3 * SLOTS).reshape(3, SLOTS, 2)
    return MixModel(code, spelling, log_odds(code.counts), *log_odds(tokens), log_odds(letters), tokens_in_all, distinct)


def lm_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known (tokens of training), train_tokens, base_score (log10, by counts alone),
    score (log10, by the mixed model) and bits_per_byte (of the words of the text; null for texts without bytes)."""
    spark = docs.sparkSession
    slices = checkpointed(token_slices(docs, id_column, text_column))

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, n = zlib.decompress(row["words"]).split(b" "), np.frombuffer(zlib.decompress(row["trained"]), np.int32)
                for at in range(0, len(words), BATCH):
                    part = words[at:at + BATCH]
                    yield pa.RecordBatch.from_pydict({
                        "slice": pa.array(np.full(len(part), row["slice"])), "place": pa.array(np.arange(at, at + len(part), dtype=np.int32)),
                        "word": pa.array(part, pa.binary()), "trained": pa.array(n[at:at + BATCH])})

    asked = slices.select("slice", "words", "trained").mapInArrow(ask, "slice bigint, place int, word binary, trained int")
    counts = checkpointed(asked.filter("trained > 0").groupBy("word").agg(F.sum("trained").alias("n")))
    model = spark.sparkContext.broadcast(fit_mix(slices, counts))

    def gather(batches):
        waiting, held = [], 0
        for batch in batches:
            waiting.append([batch.column(c).to_numpy() for c in ("slice", "place", "n")])
            held += batch.num_rows
            if held >= GATHERED:
                yield from _by_slice(waiting)
                waiting, held = [], 0
        if held:
            yield from _by_slice(waiting)

    # a slice's texts and what is known of its words come to one task; the latter in few rows
    found = asked.join(counts, "word").select("slice", "place", "n").mapInArrow(gather, "slice bigint, known binary") \
        .select("slice", "known", *[F.lit(None).cast(slices.schema[c].dataType).alias(c) for c in ("ids", "texts", "words")])
    heads = slices.select("slice", F.lit(None).cast("binary").alias("known"), "ids", "texts", "words")
    tasks = max(spark.sparkContext.defaultParallelism, slices.rdd.getNumPartitions())
    ready = heads.union(found).repartition(tasks, "slice").sortWithinPartitions("slice")
    kind = T.StructType([
        T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("held_out", T.BooleanType()),
        *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
        *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "bits_per_byte"))])

    def score(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, mix = to_arrow_schema(kind), model.value
        for row, known in _sliced(batches):
            held, sizes, lengths, tokens, words = _unpacked(row)
            n = np.zeros(len(words), np.int64)
            for part in known:
                place, own = np.frombuffer(zlib.decompress(part), np.int64).reshape(2, -1)
                n[place] = own
            begin = np.cumsum(sizes) - sizes
            base = np.log10((n + 1) / (mix.total + mix.distinct + 1))
            made = mix.log10(words, tokens, sizes)
            with np.errstate(divide="ignore", invalid="ignore"):
                rate = -made * np.log2(10) / lengths
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([
                row["ids"], held, sizes, np.add.reduceat((n > 0)[tokens].astype(np.int64), begin),
                np.full(len(sizes), mix.total), np.add.reduceat(base[tokens], begin), made,
                [float(r) if s else None for r, s in zip(rate, lengths)]], arrow)], schema=arrow)

    return ready.mapInArrow(score, kind)


def _by_slice(waiting: list[list[np.ndarray]]):
    """One row per slice of places of words and their numbers."""
    parts, place, n = (np.concatenate([w[i] for w in waiting]) for i in range(3))
    order = np.argsort(parts, kind="stable")
    parts, place, n = parts[order], place[order].astype(np.int64), n[order]
    edges = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]])).tolist()
    known = [_packed(place[a:b], n[a:b]) for a, b in zip(edges, edges[1:])]
    yield pa.RecordBatch.from_pydict({"slice": pa.array(parts[edges[:-1]]), "known": pa.array(known, pa.binary())})


def _sliced(batches):
    """Each slice's row with the packed numbers of its words."""
    key, row, known = None, None, []
    for batch in batches:
        for at, part in enumerate(batch.column("slice").to_pylist()):
            if part != key:
                if row is not None:
                    yield row, known
                key, row, known = part, None, []
            packed = batch.column("known")[at].as_py()
            if packed is not None:
                known.append(packed)
            else:
                row = {c: batch.column(c)[at].as_py() for c in ("ids", "texts", "words")}
    if row is not None:
        yield row, known
