"""A data source of paged JSON: a folder of pages as a register's interface delivers them, read page by page, as a batch or as a stream.

    spark.dataSource.register(Paged)
    spark.read.format("paged").option("path", folder).option("records", "data").option("field.name", "attributes.entity.name").schema("id string, name string").load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import eq, ge, gt, le, lt

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructType

COMPARED = {EqualTo: eq, GreaterThan: gt, GreaterThanOrEqual: ge, LessThan: lt, LessThanOrEqual: le}


class Page(InputPartition):
    """One page: a task reads it and no other."""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def pages(folder: str, suffix: str = ".json") -> list[str]:
    """The pages of a folder by name; the folder may be a path or a URI that Arrow's file systems know. Hidden files are none."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    return sorted(scheme + f.path for f in found if f.is_file and f.base_name.endswith(suffix) and f.base_name[0] not in "._")


def loaded(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(name) as f:
        return json.loads(f.read() or b"null")


def at(value, path: str):
    """What stands at a dotted path of objects; null where it leads nowhere."""
    for key in filter(None, path.split(".")):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def typed(value, kind: DataType):
    """A JSON value as a column's type; null where it is none. Objects and lists are strings of JSON."""
    if value is None or isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    try:
        return int(value) if isinstance(kind, LongType) else float(value)
    except (TypeError, ValueError):
        return None


class _Rows:
    """What batches and streams share: records of a page as rows of the schema."""

    def __init__(self, options, schema: StructType):
        self.folder, self.records = options["path"], options.get("records", "")
        self.columns = [(f.name, options.get(f"field.{f.name}", f.name), f.dataType) for f in schema.fields]
        bad = [n for n, _, kind in self.columns if not isinstance(kind, (StringType, LongType, DoubleType, BooleanType))]
        if bad:
            raise ValueError(f"columns of string, long, double or boolean only, not {bad}")
        self.kept: list[Filter] = []

    def read(self, page: Page) -> Iterator[tuple]:
        found = at(loaded(page.path), self.records)
        for record in found if isinstance(found, list) else []:
            row = {name: typed(at(record, path), kind) for name, path, kind in self.columns}
            if all(self.passes(f, row) for f in self.kept):
                yield tuple(row.values())

    @staticmethod
    def passes(f: Filter, row: dict) -> bool:
        value = row[f.attribute[0]]
        if value is None:
            return False
        if isinstance(f, IsNotNull):
            return True
        return value in f.value if isinstance(f, In) else COMPARED[type(f)](value, f.value)


class PageReader(_Rows, DataSourceReader):
    """A partition a page."""

    def partitions(self) -> list[Page]:
        return [Page(p) for p in pages(self.folder)] or [Page("")]

    def read(self, page: Page) -> Iterator[tuple]:
        return _Rows.read(self, page) if page.path else iter(())


class FilteredReader(PageReader):
    """Comparisons of a column with a constant are applied where the page is read."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (*COMPARED, In, IsNotNull)) and len(f.attribute) == 1:
                self.kept.append(f)
            else:
                yield f


class PageStream(_Rows, DataSourceStreamReader):
    """Pages in the order of their names; an offset is the number of pages read. New pages have to sort behind the old ones."""

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(pages(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(p) for p in pages(self.folder)[start["pages"] : end["pages"]]]

    def commit(self, end: dict) -> None:
        """Pages stay where they are."""


class Paged(DataSource):
    """Options: path, the folder; records, the dotted path of the list of records in a page (default: the page itself); field.NAME, the
    dotted path of a column in a record (default: its name); pushdown, true to filter pages where they are read (the session has to set
    spark.sql.python.filterPushdown.enabled too). The schema is given with the read. Pages that hold no list, and empty ones, give no
    rows; a value that does not fit its column's type is null."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> PageReader:
        return (FilteredReader if self.options.get("pushdown", "false").lower() == "true" else PageReader)(self.options, schema)

    def streamReader(self, schema: StructType) -> PageStream:
        return PageStream(self.options, schema)
