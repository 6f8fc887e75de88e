"""Side-car files: the binary annotation store of a reader, decoded in the executors, and the older section files.

A store is a signature, the value 1, a count, and that many typed values. Objects are named lists of values; some names
have a shape of their own. A file that can't be read gives one row with its error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import from_epoch_ms
from ..schemas import SECTION

# Fixed values of the format.
SIGNATURE = b"\x00\x00\x00\x00\x00\x1a\xb1\x26"
BOOLEAN, INT, LONG, UTF, DOUBLE, SHORT, FLOAT, BYTE, CHAR, OBJECT, END = 0, 1, 2, 3, 4, 5, 6, 7, 9, -2, -1
CLASSES = {0: "bookmark", 1: "highlight", 2: "note", 3: "clip_article", 10: "handwritten_note", 11: "sticky_note", 13: "underline"}
ANNOTATION_CACHE, PERSONAL = "annotation.cache.object", "annotation.personal."
NOTE_FIELDS = ("note", "handwritten_note_nbk_ref", "sticky_note_nbk_ref")
PAIRS = frozenset(("dict.prefs.v2", "EndActions", "ReaderMetrics", "StartActions", "Translator", "Wikipedia"))
SINGLES = frozenset(
    "clock.data.store dictionary lpu pdf.contrast sync_lpr tpz.line.spacing XRAY_OTA_UPDATE_STATE XRAY_SHOWING_SPOILERS XRAY_SORTING_STATE XRAY_TAB_STATE buy.asin.response.data next.in.series.info.data price.info.data erl".split()
)
FIRST_OF = frozenset(("font.prefs", "language.store"))
READING = frozenset(("fpr", "updated_lpr"))
RAW = "path string, ord bigint, annotation_type string, start_position string, end_position string, created_ms bigint, modified_ms bigint, template string, note_text string, error string"


class Malformed(ValueError):
    pass


class Cursor:
    """Reads a store's values one after the other."""

    _fixed = {INT: ">i", LONG: ">q", DOUBLE: ">d", SHORT: ">h", FLOAT: ">f", BYTE: ">b"}

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Malformed("the file ends inside a value")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def boolean(self) -> bool:
        b = self.unpack(">b")
        if b not in (0, 1):
            raise Malformed(f"{b} is no boolean")
        return bool(b)

    def utf(self) -> str:
        return "" if self.boolean() else self.take(self.unpack(">H")).decode("utf-8")

    def value(self, tag: int | None = None):
        tag = self.unpack(">b") if tag is None else tag
        if tag in self._fixed:
            return self.unpack(self._fixed[tag])
        if tag == BOOLEAN:
            return self.boolean()
        if tag == UTF:
            return self.utf()
        if tag == CHAR:
            return self.take(1).decode("utf-8")
        if tag == OBJECT:
            name, inner = self.utf(), []
            while (t := self.unpack(">b")) != END:
                inner.append(self.value(t))
            return shape(name, inner)
        raise Malformed(f"unknown data type {tag}")


def shape(name: str, values: list):
    """What a named object's values mean."""
    if name in SINGLES:
        return values[0] if values else None
    if name in PAIRS:
        n = values[0] if values else 0
        return dict(zip(values[1 : 1 + 2 * n : 2], values[2 : 2 + 2 * n : 2], strict=False))
    if name in FIRST_OF:
        return values[0] if values else None
    if name == "lpr":
        if values and isinstance(values[0], str):
            return {"position": values[0]}
        if len(values) >= 3 and values[0] <= 2:
            return {"position": values[1], "time": None if values[2] == -1 else values[2]}
        raise Malformed("lpr has an unknown version")
    if name in READING:
        fields = ("position", "time", "timeZoneOffset", "country", "device")
        return {k: None if v == -1 else v for k, v in zip(fields, values, strict=False)}
    if name == "saved.avl.interval.tree":
        n = values[0] if values else 0
        return values[1 : 1 + n]
    if name == ANNOTATION_CACHE:
        # Pairs of class id and list. An unknown id is passed over together with its list, so later classes aren't lost.
        out: dict[str, list] = {}
        n = values[0] if values else 0
        for k, held in zip(values[1 : 1 + 2 * n : 2], values[2 : 2 + 2 * n : 2], strict=False):
            if isinstance(held, dict):
                held = [r[f"{PERSONAL}{CLASSES.get(k)}"] for r in held.get("saved.avl.interval.tree", []) if isinstance(r, dict) and f"{PERSONAL}{CLASSES.get(k)}" in r]
            if not isinstance(k, int) or not isinstance(held, list):
                break
            if k in CLASSES and held:
                out[f"{PERSONAL}{CLASSES[k]}"] = held
        return out
    if name.startswith(PERSONAL) and name.removeprefix(PERSONAL) in CLASSES.values():
        row = dict(zip(("startPosition", "endPosition", "creationTime", "lastModificationTime", "template"), values, strict=False))
        if len(values) > 5:
            kind = name.removeprefix(PERSONAL)
            row["note" if kind == "note" else f"{kind}_nbk_ref"] = values[5]
        return row
    return {"_raw_values": values, "_unhandled_type": name}


def decode_store(data: bytes) -> dict:
    """The store's map; of equal keys the last stays."""
    c = Cursor(data)
    if c.take(8) != SIGNATURE:
        raise Malformed("the signature is another one")
    if c.value() != 1:
        raise Malformed("the first value isn't 1")
    store: dict = {}
    for _ in range(c.value()):
        v = c.value()
        if isinstance(v, dict):
            store.update(v)
    return store


def store_annotations(store: dict) -> list[tuple]:
    """(type, start, end, created, modified, template, note) of each annotation, in order."""
    lists = {**{k: v for k, v in (store.get(ANNOTATION_CACHE) or {}).items()}, **{k: v for k, v in store.items() if k.startswith(PERSONAL) and isinstance(v, list)}}
    out = []
    for kind, rows in lists.items():
        for r in rows:
            if not isinstance(r, dict) or "startPosition" not in r:
                continue
            out.append((kind, r["startPosition"], r.get("endPosition") or r["startPosition"], r.get("creationTime"), r.get("lastModificationTime"), r.get("template"), r.get("note")))
    return out


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in RAW.split(", ")]
    types = [pa.int64() if f.endswith("bigint") else pa.string() for f in RAW.split(", ")]
    for b in batches:
        rows: list[tuple] = []
        for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                found = store_annotations(decode_store(data or b""))
                rows += [(path, i, *a, None) for i, a in enumerate(found)]
            except (Malformed, UnicodeDecodeError, TypeError, IndexError) as e:
                rows.append((path, 0, *[None] * 7, str(e)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def decode_annotations(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Annotations of side-car bytes: book_id (the path), ord, annotation_type, positions, times (UTC), template, note_text, error."""
    raw = files.select(F.col(path).cast("string"), F.col(content).cast("binary")).mapInArrow(_decode, RAW)
    return raw.select(
        F.col("path").alias("book_id"), "ord", "annotation_type", "start_position", "end_position", from_epoch_ms("created_ms").alias("creation_time"), from_epoch_ms("modified_ms").alias("last_modification_time"), "template", "note_text", "error"
    )


def read_sidecars(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return decode_annotations(spark.read.format("binaryFile").load(path))


def read_annotations_json(spark: SparkSession, path: str) -> DataFrame:
    """The JSON form of a store: a map from annotation type to a list of annotations."""
    entry = "struct<text:string,startPosition:string,endPosition:string,creationTime:string>"
    raw = spark.read.schema(f"`{ANNOTATION_CACHE}` map<string, array<{entry}>>").option("multiLine", True).json(path)
    return raw.select(F.explode(F.col(f"`{ANNOTATION_CACHE}`")).alias("annotation_type", "_list")).select("annotation_type", F.posexplode("_list").alias("ord", "a")).select(
        "annotation_type", F.col("ord").cast("long").alias("ord"), F.col("a.startPosition").alias("start_position"), F.coalesce("a.endPosition", "a.startPosition").alias("end_position"), F.col("a.creationTime").alias("creation_time"), F.col("a.text").alias("note_text")
    )


def categories(c):
    """Short name of the four common annotation types; others pass."""
    known = F.create_map(*[F.lit(x) for k in ("highlight", "note", "bookmark", "underline") for x in (f"{PERSONAL}{k}", k)])
    return F.coalesce(known[c], c)


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in SECTION.split(", ")]
    for b in batches:
        rows: list[tuple] = []
        for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = data or b""
            if len(data) < 16:
                rows.append((path, 0, None, None, "the header is too short"))
                continue
            at, n = 16, 0
            while at + 8 <= len(data):
                kind, length = struct.unpack_from(">II", data, at)
                if at + 8 + length > len(data):
                    break  # a section that is cut off ends the file
                text = data[at + 8 : at + 8 + length].decode("utf-8", "ignore")
                if kind == 2 or (kind == 1 and text.strip()):
                    rows.append((path, n, kind, text.strip() if kind == 1 else text, None))
                n += 1
                at += 8 + length
        if rows:
            types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def decode_sections(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Annotation (type 1) and metadata (type 2) sections of the older files."""
    return files.select(F.col(path).cast("string"), F.col(content).cast("binary")).mapInArrow(_sections, SECTION)
