"""Fill-in-the-middle: texts cut in three and put in another order, and put back.

Secondary sort: every text becomes pieces of at most UNIT characters, keyed by
the document and their position in the output.  One shuffle by document and a
sort within partitions bring them to a task in output order, where they stream
through an incremental digest; a second sort of the same partitions, by the
position in the restored text, streams them through another.  No task holds
more than a piece of a text once it is cut.
"""

from __future__ import annotations

import dataclasses
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 1 << 16
#: Fixed values of the format: the marks, and the order of regions in each form.
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
ORDERS = {"psm": "PSM", "spm": "SPM"}
RESTORED = "PMS"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes of pieces in an Arrow batch.
BATCH_BYTES = 4 << 20


@dataclasses.dataclass
class Cut:
    """How a text is to be cut: its characters, its form, and the bounds of its middle."""

    n: int
    form: str
    left: int = 0
    right: int = 0


def cut(doc_id: object, text: str) -> Cut:
    """The form and the bounds follow from the id alone, and from what the text holds."""
    n, digest = len(text), hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= PLAIN_FROM or any(m.decode() in text for m in MARKS.values()):
        return Cut(n, "plain")
    left, right = sorted((h1 % (n + 1), h2 % (n + 1)))
    return Cut(n, "spm" if h4 % 100 < SPM_BELOW else "psm", left, right)


def output_pieces(text: str, how: Cut, unit: int = UNIT) -> Iterator[bytes]:
    """The output in order, in pieces of at most `unit` characters of text; a region's first piece begins with its mark."""
    if how.form == "plain":
        regions = [(b"", 0, how.n)]
    else:
        bounds = {"P": (0, how.left), "M": (how.left, how.right), "S": (how.right, how.n)}
        regions = [(MARKS[r], *bounds[r]) for r in ORDERS[how.form]]
    for mark, start, end in regions:
        for at in range(start, max(end, start + 1), unit):
            yield (mark if at == start else b"") + text[at : min(at + unit, end)].encode()


class Restorer:
    """Reads an output piece by piece and tells where each part belongs in the text; knows only the form."""

    def __init__(self, form: str):
        self.ahead = list(ORDERS.get(form, ""))
        self.region = RESTORED[0]
        self.held = b""

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        """(region's place in the text, bytes); the last bytes are held back while a mark may begin in them."""
        data = self.held + data
        while self.ahead and (at := data.find(MARKS[self.ahead[0]])) >= 0:
            if at:
                yield RESTORED.index(self.region), data[:at]
            self.region, data = self.ahead.pop(0), data[at + 3 :]
        keep = min(2, len(data)) if self.ahead and not last else 0
        self.held = data[len(data) - keep :]
        if len(data) > keep:
            yield RESTORED.index(self.region), data[: len(data) - keep]


class Rows:
    """Rows gathered into Arrow batches of about BATCH_BYTES."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.columns, self.bytes = schema, [[] for _ in schema], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        for c, v in zip(self.columns, row):
            c.append(v)
        self.bytes += size + 100
        if self.bytes >= BATCH_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
        self.columns, self.bytes = [[] for _ in self.schema], 0


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in b.slice(k, 256).columns))


def pack(data: bytes) -> bytes:
    """Pieces are shuffled and sorted compressed."""
    return zlib.compress(data, 1)


def emit(batches: Iterator[pa.RecordBatch], schema: pa.Schema, unit: int) -> Iterator[pa.RecordBatch]:
    """Documents to pieces; the first piece of each carries the id and the cut."""
    rows = Rows(schema)
    for batch in batches:
        part = batch.column(0)[0].as_py() if batch.num_rows else 0
        for k in range(batch.num_rows):
            doc_id, text = batch.column(1)[k].as_py(), batch.column(2)[k].as_py() or ""
            how, key = cut(doc_id, text), hashlib.sha256(f"{doc_id}:".encode() + text.encode()).digest()
            for at, data in enumerate(output_pieces(text, how, unit)):
                head = (doc_id, how.n, how.form, how.left, how.right - how.left) if at == 0 else (None,) * 5
                packed = pack(data)
                yield from rows.add((part, key, at, packed, *head), len(packed))
    yield from rows.rest()


def digest_outputs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces in output order to pieces with their places in the text, and after them a row with the digest of the output.

    Equal rows of a task's input have equal pieces, which arrive side by side:
    one of them is read, and the row that closes the document counts them.
    """
    rows, key, copies, last = Rows(schema), None, 0, -1
    digest, reader, head, seq = hashlib.sha256(), Restorer("plain"), (None,) * 5, 0

    def close() -> Iterator[pa.RecordBatch]:
        for region, data in reader.feed(b"", last=True):
            yield from rows.add((*key, region, seq, pack(data), *(None,) * 7), len(data))
        yield from rows.add((*key, len(RESTORED), 0, None, *head, digest.hexdigest(), copies), 300)

    for part, own, at, packed, *cols in records(batches):
        if (part, own) != key:
            if key:
                yield from close()
            key, copies, last, head, seq = (part, own), 0, -1, tuple(cols), 0
            digest, reader = hashlib.sha256(), Restorer(cols[2])
        copies += at == 0
        if at == last:
            continue
        last, data = at, zlib.decompress(packed)
        digest.update(data)
        for region, found in reader.feed(data):
            yield from rows.add((*key, region, seq, pack(found), *(None,) * 7), len(found))
            seq += 1
    if key:
        yield from close()
    yield from rows.rest()


def digest_restored(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of the text to a row for each document, with the digest of what they restore."""
    rows, digest = Rows(schema), hashlib.sha256()
    for data, doc_id, n, form, prefix, middle, output, copies in records(batches):
        if data is not None:
            digest.update(zlib.decompress(data))
            continue
        sizes = (prefix, middle) if form != "plain" else (None, None)
        for _ in range(copies):
            yield from rows.add((doc_id, n, form, *sizes, output, digest.hexdigest()), 300)
        digest = hashlib.sha256()
    yield from rows.rest()


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """The output of every document as pieces (part, key, at, data), to be read by `at` within (part, key); data is compressed.

    Written in this order, they are the transformed corpus itself.
    """
    tag = uuid.uuid4().hex
    rows = docs.select(F.spark_partition_id().alias(f"part_{tag}"), F.col(id_col).alias(f"id_{tag}"), F.col(text_col).alias(f"text_{tag}"))
    kind = rows.schema[f"id_{tag}"].dataType.simpleString()
    spec = f"part int, key binary, at int, data binary, id {kind}, n long, form string, prefix_chars long, middle_chars long"
    id_type = _arrow(rows, f"id_{tag}")
    schema = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("at", pa.int32()), ("data", pa.binary()), ("id", id_type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])
    return rows.mapInArrow(lambda batches: emit(batches, schema, unit), spec)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every whole text.

    A null text is empty, and an empty text plain.  The key of a document is
    the input partition and a digest of its id and text: rows that repeat both
    are read once for each partition and given as often as they occur, other
    rows of one id are documents of their own, and a null id counts as "None".
    A hot id or text is spread by its partitions.  A very long text is held
    whole only where it is cut; after that it is pieces of `unit` characters.
    The text is rebuilt from the output and the form alone.  An empty table
    gives no rows; other columns may have any name.
    """
    made = pieces(docs, id_col, text_col, unit)
    kind, id_type = made.schema["id"].dataType.simpleString(), _arrow(made, "id")
    head = [("id", id_type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    middle = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("region", pa.int32()), ("seq", pa.int32()), ("data", pa.binary()), *head, ("output_sha256", pa.string()), ("copies", pa.int32())])
    last = pa.schema([*head, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
    columns = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"
    in_output = made.repartition("part", "key").sortWithinPartitions("part", "key", "at")
    placed = in_output.mapInArrow(lambda b: digest_outputs(b, middle), f"part int, key binary, region int, seq int, data binary, {columns}, copies int")
    in_text = placed.sortWithinPartitions("part", "key", "region", "seq").drop("part", "key", "region", "seq")
    return in_text.mapInArrow(lambda b: digest_restored(b, last), f"{columns}, restored_sha256 string").withColumnRenamed("id", id_col)
