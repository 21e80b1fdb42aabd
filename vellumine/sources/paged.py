"""Tables behind a paged interface, as a data source over its recorded replies.

A reply is JSON with `items`, `has_more` and `page_token`, kept at view=<view>/token=<token>/ in a
folder; the field list is the view `_fields`. Tokens that are numbers may be packed: `_PACK` of them
from a multiple on are lines of token, tab and reply at view=<view>/pages=<number / _PACK>/. A page of
its own counts before a packed one. The scan follows tokens from the first page of each view (one
partition a view, of packed pages one for `_RUN` packs), asks for the fields of the schema only, and
refuses a token that it has seen. Replies are sorted by time, newest first, so a pushed filter on `last_modified` (or `limit`)
stops the scan. The stream starts with the oldest page and its offset is a token and a place.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, StringType, StructField, StructType, TimestampType

from ..operators.rank_directory import RankDirectory
from ..storage import scratch_path

#: The token of a view's first page.
FIRST = "0"
#: Most records of a page.
MOST = 500
#: Pages of a pack, and packs of a partition.
_PACK, _RUN = 32, 8
ID, TIME = "record_id", "last_modified"
TYPES: dict[str, DataType] = {"text": StringType(), "number": DoubleType(), "checkbox": BooleanType(), "datetime": TimestampType(), "list": ArrayType(StringType())}


class PagedError(ValueError):
    """Replies that contradict the interface."""


class Replies:
    """Recorded replies of one folder, on any file system that pyarrow reads."""

    def __init__(self, folder: str, audit: str | None = None):
        from pyarrow import fs

        self._file_system, self._folder = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        self._audit = audit
        self._pack: tuple[tuple[str, int], dict[str, bytes]] = ("", -1), {}

    def _files(self, folder: str) -> list[str]:
        from pyarrow import fs

        found = self._file_system.get_file_info(fs.FileSelector(f"{self._folder}/{folder}", allow_not_found=True))
        return sorted(f.path for f in found if not f.base_name.startswith((".", "_")) or f.base_name.startswith("view="))

    def views(self) -> list[str]:
        return [n for p in self._files("") if (n := p.rpartition("view=")[2]) != p and n != "_fields"]

    def packs(self, view: str) -> list[int]:
        """Numbers of the packs that a view has."""
        return sorted(int(n) for p in self._files(f"view={view}") if (n := p.rpartition("/pages=")[2]).isdecimal() and n != p)

    def _read(self, path: str) -> bytes:
        with self._file_system.open_input_stream(path) as stream:
            return stream.read()

    def _packed(self, view: str, token: str) -> bytes | None:
        if not token.isdecimal():
            return None
        key = view, int(token) // _PACK
        if self._pack[0] != key:
            files = self._files(f"view={view}/pages={key[1]}")
            lines = [line.partition(b"\t") for f in files for line in self._read(f).split(b"\n") if line]
            self._pack = key, {own.decode(): reply for own, _, reply in lines}
        return self._pack[1].get(token)

    def page(self, view: str, token: str) -> dict:
        files = self._files(f"view={view}/token={token}")
        found = self._read(files[0]) if files else self._packed(view, token)
        if found is None:
            raise PagedError(f"no reply for token {token} of view {view}")
        if self._audit:
            folder = Replies(self._audit)
            folder._file_system.create_dir(folder._folder)
            with folder._file_system.open_append_stream(f"{folder._folder}/{view}-{token}") as out:
                out.write(b".")
        reply = json.loads(found.decode())
        if not isinstance(reply, dict) or not isinstance(reply.get("items", []), list):
            raise PagedError(f"the reply for token {token} of view {view} is no page")
        return reply

    def pages(self, view: str, token: str = FIRST, end: str | None = None) -> Iterator[tuple[str, dict]]:
        """Pages from a token on, before the token `end` if given; each token may come once."""
        seen: set[str] = set()
        while True:
            seen.add(token)
            reply = self.page(view, token)
            yield token, reply
            if not reply.get("has_more"):
                if end is not None:
                    raise PagedError(f"view {view} ends before token {end}")
                return
            following = reply.get("page_token")
            if not isinstance(following, str) or not following or following in seen:
                raise PagedError(f"view {view} has an invalid page token behind {token}")
            if following == end:
                return
            token = following


def _instant(value: object) -> datetime | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=value)


def _texts(value: object) -> str | None:
    return value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False)


_READ: dict[type[DataType], Callable[[object], object]] = {
    StringType: _texts,
    DoubleType: lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None,
    BooleanType: lambda v: v if isinstance(v, bool) else None,
    TimestampType: _instant,
    ArrayType: lambda v: [_texts(x) for x in v] if isinstance(v, list) else None,
}


def rows_of(reply: dict, schema: StructType) -> Iterator[tuple]:
    """Records of a page by the schema; what a field can't hold is null, a record without an id is refused."""
    for item in reply.get("items", []):
        if not isinstance(item, dict) or not isinstance(item.get(ID), str) or not item[ID]:
            raise PagedError(f"a record has no {ID}")
        fields = item.get("fields")
        own = (fields if isinstance(fields, dict) else {}) | {ID: item[ID], TIME: item.get(TIME)}
        yield tuple(_READ[type(f.dataType)](own.get(f.name)) for f in schema.fields)


class ViewPartition(InputPartition):
    def __init__(self, view: str, start: str = FIRST, end: str | None = None):
        super().__init__(view)
        self.view, self.start, self.end = view, start, end


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.cutoff: tuple[datetime, bool] | None = None

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """A lower bound of the time ends the scan; all other filters stay with Spark."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == (TIME,) and isinstance(f.value, datetime):
                bound = (f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc), isinstance(f, GreaterThan))
                self.cutoff = max(self.cutoff or bound, bound)
            else:
                yield f

    def partitions(self) -> list[ViewPartition]:
        wanted, replies = self.options.get("view"), Replies(self.options["path"])
        views = [wanted] if wanted else replies.views()
        if "limit" in self.options:  # a limit counts from the first page of a view
            return [ViewPartition(v) for v in views]
        out = []
        for v in views:
            starts = [FIRST, *[str(n * _PACK) for n in replies.packs(v) if n and n % _RUN == 0]]
            out += [ViewPartition(v, *bounds) for bounds in zip(starts, [*starts[1:], None])]
        return out

    def read(self, partition: ViewPartition) -> Iterator[tuple]:
        left = int(self.options.get("limit", 1 << 62))
        # the time is read too, even where it isn't asked for
        timed = StructType([*self.schema.fields, StructField(TIME, TimestampType())])
        for _, reply in Replies(self.options["path"], self.options.get("audit")).pages(partition.view, partition.start, partition.end):
            for row in rows_of(reply, timed):
                at = row[-1]
                if self.cutoff and (at is None or at < self.cutoff[0] or at == self.cutoff[0] and self.cutoff[1]):
                    if at is not None:
                        return  # all that follow are as old or older
                    continue
                if not left:
                    return
                left -= 1
                yield row[:-1]


class PagedStream(SimpleDataSourceStreamReader):
    """A view as a stream: recorded with the oldest page first, it grows at its end."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"token": FIRST, "place": 0}

    def _from(self, start: dict, until: dict | None) -> tuple[list[tuple], dict]:
        rows: list[tuple] = []
        most = int(self.options.get("pages", 8))
        place, at = start["place"], dict(start)
        for n, (token, reply) in enumerate(Replies(self.options["path"], self.options.get("audit")).pages(self.options["view"], start["token"])):
            if until is None and n == most:
                break
            own = list(rows_of(reply, self.schema))
            end = until["place"] if until and until["token"] == token else len(own)
            rows += own[place:end]
            place, at = 0, {"token": token, "place": end}
            if until and until["token"] == token:
                break
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._from(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._from(start, end)[0])


class PagedSource(DataSource):
    """Format `paged`: options path, view (all unless given), fields (comma-separated), limit, audit, pages.

    record_id and last_modified come first, then the listed fields. `audit` names a folder with a
    file per page read, a byte longer each time. `pages` is the most pages of a stream's batch.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> StructType:
        """By the field list, itself in pages; fields of an unknown type are text."""
        listed: dict[str, DataType] = {}
        for _, reply in Replies(self.options["path"]).pages("_fields"):
            for item in reply.get("items", []):
                listed.setdefault(item["field_name"], TYPES.get(item.get("type"), StringType()))
        wanted = [f.strip() for f in self.options.get("fields", "").split(",") if f.strip()] or list(listed)
        unknown = [f for f in wanted if f not in listed]
        if unknown:
            raise PagedError(f"the table has no fields {unknown}")
        return StructType([StructField(ID, StringType()), StructField(TIME, TimestampType()), *[StructField(f, listed[f]) for f in wanted]])

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> PagedStream:  # noqa: N802
        if not self.options.get("view"):
            raise PagedError("a stream reads one view")
        return PagedStream(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, with pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def _type_name(kind: DataType) -> str:
    return next((n for n, t in TYPES.items() if isinstance(kind, type(t))), "number" if kind.simpleString() in ("int", "bigint", "float", "smallint") else "text")


def record(rows: DataFrame, path: str, view: Column, id_: Column, time: Column, size: int = MOST, newest_first: bool = True) -> None:
    """Writes rows as the pages that a table of them would reply with; all columns are fields.

    Positions come from a rank directory, so no view is gathered; each page is one task's row. Full
    packs are a file each; the pages behind them, where a view grows, have files of their own.
    """
    if not 1 <= size <= MOST:
        raise ValueError(f"a page has 1 to {MOST} records")
    fields = rows.columns
    spark = rows.sparkSession
    at = F.unix_millis(time.cast("timestamp"))
    values = F.to_json(F.struct(*[F.unix_millis(F.col(c).cast("timestamp")).alias(c) if rows.schema[c].dataType.simpleString().startswith("timestamp") else F.col(c) for c in fields]))
    named = rows.select(view.cast("string").alias("view"), id_.cast("string").alias("id"), at.alias("at"), values.alias("fields"))
    newest = F.desc_nulls_last("at") if newest_first else F.asc_nulls_first("at")
    ranked = RankDirectory.build(named, [F.col("view"), newest, F.col("id"), F.col("fields")], scratch_path(spark, "record"))
    placed = ranked.positions()
    firsts = placed.groupBy("view").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    paged = placed.join(firsts, "view").withColumn("page", F.floor((F.col("position") - F.col("first")) / size).cast("long"))
    item = F.concat(F.lit('{"record_id":'), F.expr("substr(to_json(array(id)), 2, length(to_json(array(id))) - 2)"), F.lit(',"last_modified":'), F.coalesce(F.col("at").cast("string"), F.lit("null")), F.lit(',"fields":'), F.col("fields"), F.lit("}"))
    pages = paged.groupBy("view", "page").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", item.alias("item")))), lambda x: x["item"]), ",").alias("items"), F.first("n").alias("n")
    )
    more = (F.col("page") + 1) * size < F.col("n")
    following = F.when(more, F.concat(F.lit(',"page_token":"'), (F.col("page") + 1).cast("string"), F.lit('"'))).otherwise("")
    reply = F.concat(F.lit('{"items":['), "items", F.lit('],"has_more":'), more.cast("string"), following, F.lit("}"))
    kept = scratch_path(spark, "pages")  # both kinds are written from it
    in_pack = F.col("page") < F.floor(F.ceil(F.col("n") / size) / _PACK) * _PACK
    pages.select("view", "page", in_pack.alias("in_pack"), reply.alias("value")).write.parquet(kept)
    done = spark.read.parquet(kept)
    line = F.concat(F.col("page").cast("string"), F.lit("\t"), F.col("value")).alias("value")
    packs = done.where("in_pack").select("view", F.floor(F.col("page") / _PACK).cast("long").alias("pages"), line)
    packs.repartition("view", "pages").write.partitionBy("view", "pages").mode("append").text(path)
    own = done.where("not in_pack").select("view", F.col("page").cast("string").alias("token"), "value")
    own.write.partitionBy("view", "token").mode("append").text(path)
    listed = json.dumps({"items": [{"field_name": c, "type": _type_name(rows.schema[c].dataType)} for c in fields], "has_more": False})
    one = spark.createDataFrame([("_fields", FIRST, listed)], "view string, token string, value string")
    one.coalesce(1).write.partitionBy("view", "token").mode("append").text(path)
