"""Byte-level BPE in DuckDB, one connection a Python worker: recursive queries encode, an ordered aggregation decodes.

A vocabulary is a file of lines "base64 of a token's bytes, rank"; a token's rank is its id. The merge table has a row for
each way to put a token together from two others. A recursive query contracts, in each piece of text at once, the leftmost
of the adjacent pairs of least rank, until no pair of neighbours is in the merge table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Code points of the texts that are encoded at once, ids that are decoded at once; chunks and pieces that a worker keeps.
CHARS, IDS, KEPT = 1 << 20, 1 << 18, 300_000
#: Bytes of a piece whose intermediate states are kept during the recursion (they are about the square of that).
SHORT = 64
#: Pieces that go into one query.
LOT = 20_000
# The Unicode property White_Space, letters, and ASCII characters that are no letters.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS, _OTHERS = "A-Za-zÀ-ÖØ-öø-ÿ", r"\x00-\x40\x5b-\x60\x7b-\x7f"
#: White space with a word that ends surely, or with all up to white space: no match of the pattern goes over their ends.
_CHUNK = re.compile(rf"[{_SPACE}]*(?:[{_LETTERS}]+(?=[{_OTHERS}]|\Z)|[^{_SPACE}]+)|[{_SPACE}]+")

# Each row is a piece with its tokens; its pairs of neighbours are rows with a place that join the merge table.
_PAIRS = "SELECT n.w, i, rank, calm FROM (SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, unnest(range(1, len(toks))) AS i FROM s) n JOIN merge m ON m.l = n.l AND m.r = n.r"
_ENCODE_SHORT = f"""
WITH RECURSIVE s(w, step, toks) AS (
  SELECT w, 0, toks FROM begun
  UNION ALL
  SELECT s.w, step + 1, toks[:(b.best & 4294967295) - 1] || [(b.best >> 32)::INT] || toks[(b.best & 4294967295) + 2:]
  FROM s JOIN (SELECT w, min(rank * 4294967296 + i) AS best FROM ({_PAIRS}) GROUP BY w) b ON b.w = s.w)
SELECT w, arg_max(toks, step) AS toks FROM s GROUP BY w
"""
# Of a long piece only the last state is kept. All its pairs of least rank are contracted at once, from the left, where no
# pair with the new token can have a lesser rank ("calm"): then one after the other gives the same.
_ENCODE_LONG = f"""
WITH RECURSIVE s(w, toks) USING KEY (w) AS (
  SELECT w, toks FROM begun
  UNION
  (WITH x AS MATERIALIZED ({_PAIRS}),
  b AS MATERIALIZED (SELECT w, rank, any_value(calm) AND count(*) > 1 AS many, min(i) AS p FROM x GROUP BY w, rank QUALIFY rank = min(rank) OVER (PARTITION BY w)),
  h AS MATERIALIZED (SELECT w, rank, i FROM (SELECT w, rank, i, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run FROM x JOIN b USING (w, rank) WHERE many) QUALIFY (i - min(i) OVER (PARTITION BY w, run)) % 2 = 0)
  SELECT s.w, toks[:p - 1] || [rank::INT] || toks[p + 2:] FROM s JOIN b ON b.w = s.w WHERE NOT many
  UNION ALL
  SELECT t.w, list(coalesce(h.rank::INT, t.t) ORDER BY t.i) FROM (SELECT s.w, unnest(toks) AS t, unnest(range(1, len(toks) + 1)) AS i FROM s JOIN b ON b.w = s.w WHERE many) t
    LEFT JOIN h ON h.w = t.w AND h.i = t.i ANTI JOIN h g ON g.w = t.w AND g.i = t.i - 1 GROUP BY t.w))
SELECT w, toks FROM s
"""
_DECODE = "SELECT part, unhex(string_agg(hex, '' ORDER BY place)) AS bytes FROM ids JOIN vocabulary USING (id) GROUP BY part"


def read_vocabulary(path: str) -> bytes:
    """The content of a vocabulary file, which goes to the tasks (about 1 MB)."""
    return Path(path).read_bytes()


class Known:
    """What was met in this generation or the one before; a generation ends at ``KEPT`` entries."""

    def __init__(self):
        self.now: dict = {}
        self.before: dict = {}

    def missing(self, wanted: set) -> list:
        """What of ``wanted`` isn't known; all else of it is in ``now`` until the next call."""
        if len(self.now) > KEPT:
            self.before, self.now = self.now, {}
        new = []
        for k in wanted:
            if k not in self.now:
                if (x := self.before.get(k)) is None:
                    new.append(k)
                else:
                    self.now[k] = x
        return new


class Coder:
    """A vocabulary in DuckDB, and the pieces met before, of which a bounded number is kept."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.chunks, self.pieces = Known(), Known()
        rows = [(a, b, r) for token, r in self.ranks.items() for k in range(1, len(token)) if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None]
        hasty = {x for a, b, r in rows for x in (a, b) if x > r}  # tokens in pairs of lesser rank than their own
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        a, b, r = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        self._table("merge", l=a.astype(np.int32), r=b.astype(np.int32), rank=r, calm=np.array([x not in hasty for x in r.tolist()], bool))
        self._table("vocabulary", id=np.array(list(self.ranks.values()), np.int32), hex=[t.hex() for t in self.ranks])

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _merged(self, pieces: list[bytes], query: str) -> None:
        """Tokens of pieces, as little-endian ids."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        toks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]))
        self.db.register("begun", pa.table({"w": pa.array(range(len(pieces)), pa.int32()), "toks": toks}))
        got = self.db.sql(query).to_arrow_table()
        self.db.unregister("begun")
        lists = got["toks"].combine_chunks()
        ids, ends = lists.flatten().to_numpy().astype("<u4").tobytes(), ((lists.offsets.to_numpy() - lists.offsets[0].as_py()) * 4).tolist()
        self.pieces.now.update((pieces[w], ids[i:j]) for w, i, j in zip(got["w"].to_pylist(), ends, ends[1:]))

    def _learn(self, chunks: list[str]) -> None:
        split = {c: [p.encode() for p in self.pattern.findall(c)] for c in chunks}
        new = self.pieces.missing({p for ps in split.values() for p in ps})
        whole = [p for p in new if p in self.ranks]  # a piece that is a token is that token
        self.pieces.now.update((p, self.ranks[p].to_bytes(4, "little")) for p in whole)
        rest = sorted(p for p in new if p not in self.ranks)
        short, long = [p for p in rest if len(p) <= SHORT], [p for p in rest if len(p) > SHORT]
        for i in range(0, len(short), LOT):
            self._merged(short[i : i + LOT], _ENCODE_SHORT)
        for p in long:
            self._merged([p], _ENCODE_LONG)
        for c, ps in split.items():
            self.chunks.now[c] = b"".join([self.pieces.now[p] for p in ps])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids. Texts are taken in chunks, as these come again and again."""
        split = [_CHUNK.findall(t) for t in texts]
        self._learn(self.chunks.missing({c for x in split for c in x}))
        known = self.chunks.now
        return [b"".join([known[c] for c in x]) for x in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of texts from their ids: parts of bounded size, each put together in the order of its places."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        size = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        text = np.repeat(np.arange(len(ids)), size)
        out: list[list[bytes]] = [[] for _ in ids]
        for i in range(0, len(flat), IDS):
            n = len(flat[i : i + IDS])
            self.db.register("ids", pa.table({"part": text[i : i + IDS], "place": pa.array(np.arange(n), pa.int32()), "id": flat[i : i + IDS]}))
            for part, b in self.db.execute(_DECODE).fetchall():
                out[part].append(b)
            self.db.unregister("ids")
        return [b"".join(x) for x in out]


_CODERS: dict[tuple[bytes, str], Coder] = {}


def _coder(vocabulary: bytes, pattern: str) -> Coder:
    """The worker's own."""
    if (vocabulary, pattern) not in _CODERS:
        _CODERS.clear()
        _CODERS[vocabulary, pattern] = Coder(vocabulary, pattern)
    return _CODERS[vocabulary, pattern]


def _lots(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of about ``most`` in all, one item at least."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def encode_texts(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """The columns of ``docs`` with n_tokens and ids, the tokens of the whole text as little-endian unsigned 32-bit numbers.

    Each match of ``pattern`` is encoded by itself; there are no special tokens. A null text is an empty one and has no
    tokens. Columns n_tokens and ids of the input are replaced; repeated rows stay; an empty table gives an empty one.
    A run of n letters without an end costs n steps or fewer over n tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary, pattern)
        for b in batches:
            texts = [t or "" for t in b.column("_text").to_pylist()]
            for i, j in _lots([len(t) for t in texts], CHARS):
                ids = coder.encode(texts[i:j])
                kept = b.slice(i, j - i).drop_columns(["_text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [*kept.schema.names, "n_tokens", "ids"])

    kept = docs.drop("n_tokens", "ids")
    schema = StructType([*kept.schema.fields, StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
    return kept.withColumn("_text", F.col("text").cast("string")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, vocabulary: bytes) -> DataFrame:
    """The columns of ``encoded`` with decoded, the bytes that its ids stand for. Null ids are none; an id that is not in
    the vocabulary stands for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary, "")
        for b in batches:
            ids = [x or b"" for x in b.column("ids").to_pylist()]
            for i, j in _lots([len(x) // 4 for x in ids], IDS):
                kept = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(coder.decode(ids[i:j]), pa.binary())], [*kept.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("decoded", BinaryType())]))
