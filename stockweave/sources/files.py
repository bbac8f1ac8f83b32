"""BOM files: CSV, TSV and XLSX to long cells or wide frames, and single-file exports.

Files are read whole by Spark's binaryFile source, one row a file, and parsed in Arrow batches; any number of files, on
any store that Spark reads, in parallel.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import os
import re
import textwrap
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave import catalog
from stockweave.operators import headers, normalize

#: Rows of a file that become cells at once.
ROWS = 4096
CELLS = "file string, row_index int, col_pos int, col_name string, value string"


def encoding_of(data: bytes) -> str:
    """UTF-8 (with or without a mark at its start), else Windows-1252, else Latin-1."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            data.decode(encoding)
            return encoding
        except UnicodeDecodeError:
            pass
    return "latin-1"


def decode(data: bytes) -> str:
    return data.decode(encoding_of(data))


def delimiter(text: str, name: str) -> str:
    """By the counts in the first line; what csv.Sniffer finds in the first 1024 characters goes before that."""
    line = text.partition("\n")[0]
    tabs, semis, commas = (line.count(c) for c in "\t;,")
    guess = "\t" if name.lower().endswith(".tsv") or tabs > max(semis, commas) else ";" if semis > commas else ","
    try:
        return csv.Sniffer().sniff(text[:1024], delimiters=",;\t").delimiter
    except csv.Error:
        return guess


#: Columns and rows. Rows may come as they are asked for.
Rows = tuple[list, Iterable[dict]]


def scan_csv(data: bytes, name: str) -> Rows:
    """parse_csv with rows as they are asked for, so a file's rows are never all in memory."""
    if not data:
        return [], []
    encoding = encoding_of(data)
    lines = lambda: io.TextIOWrapper(io.BytesIO(data), encoding, newline="")
    # of the text only the first line and what delimiter() sniffs at
    head = lines().read(1024)
    while "\n" not in head and (more := len(head)) and len(head := lines().read(2 * more)) > more:
        pass
    try:
        reader = csv.DictReader(lines(), delimiter=delimiter(head, name))
        names = list(dict.fromkeys(reader.fieldnames or []))
    except csv.Error as e:
        raise ValueError(f"{name}: {e}") from e

    def rows() -> Iterator[dict]:
        try:
            for r in reader:
                yield {k: "" if v is None else str(v) for k, v in r.items() if k is not None}
        except csv.Error as e:
            raise ValueError(f"{name}: {e}") from e

    return names, rows()


def parse_csv(data: bytes, name: str) -> tuple[list, list[dict]]:
    """(header, rows as dicts of text): the first row names the columns, blank lines go, short rows are filled, of equal
    names the last counts, and what is beyond the header is dropped."""
    names, rows = scan_csv(data, name)
    return names, list(rows)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _number(text: str) -> str:
    return text if not re.fullmatch(r"-?[0-9]+\.0+", text) else text.split(".")[0]


def parse_xlsx(data: bytes, name: str) -> Rows:
    """The active sheet's cached values; the first row names the columns. Cells are text; empty ones are null."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        read = lambda p: ET.fromstring(z.read(p))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in read("xl/sharedStrings.xml")]
        book = read("xl/workbook.xml")
        view = next(book.iter(f"{_NS}workbookView"), None)
        sheet = list(book.iter(f"{_NS}sheet"))[int(view.get("activeTab", 0)) if view is not None else 0]
        target = next(r.get("Target") for r in read("xl/_rels/workbook.xml.rels") if r.get("Id") == sheet.get(f"{_REL}id"))
        table = []
        for row in read(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter(f"{_NS}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{_NS}c"):
                letters = re.match(r"[A-Z]*", c.get("r", "")).group()
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                at = at - 1 if letters else len(cells)
                v, kind = c.find(f"{_NS}v"), c.get("t", "n")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else ("True" if v.text == "1" else "False") if kind == "b" else _number(v.text) if kind == "n" else v.text
            table.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    if not table:
        return [], []
    header = [None if h is None else str(h) for h in table[0]]
    return list(dict.fromkeys(header)), [dict(zip(header, r + [None] * (len(header) - len(r)), strict=False)) for r in table[1:]]


#: Suffixes and parsers, tried in order; register() adds to them.
ADAPTERS: list[tuple[tuple[str, ...], Callable[[bytes, str], Rows]]] = [((".csv", ".tsv"), scan_csv), ((".xlsx", ".xls"), parse_xlsx)]


def register(suffixes: tuple[str, ...], parser: Callable[[bytes, str], Rows]) -> None:
    ADAPTERS.append((suffixes, parser))


def adapter(path: str) -> Callable[[bytes, str], Rows]:
    for suffixes, parser in ADAPTERS:
        if path.lower().endswith(suffixes):
            return parser
    raise ValueError(f"no adapter reads {path}")


def read_cells(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, row_index, col_pos, col_name, value of all cells of BOM files."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    parsers = {p.lower().rpartition(".")[2]: adapter(p) for p in paths if "*" not in p.rpartition("/")[2]}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                columns, rows = (parsers.get(path.lower().rpartition(".")[2]) or adapter(path))(bytes(content), path)
                rows = iter(rows)
                for at in itertools.count(0, ROWS):
                    part = list(itertools.islice(rows, ROWS))
                    if not part:
                        break
                    n, m = len(part), len(columns)
                    yield pd.DataFrame({
                        "file": path, "row_index": np.repeat(np.arange(at, at + n, dtype=np.int32), m), "col_pos": np.tile(np.arange(m, dtype=np.int32), n),
                        "col_name": columns * n, "value": [r.get(c) for r in part for c in columns],
                    })

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(parse, CELLS)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """One file as a wide frame of text with row_index; column names come from the file's header (metadata)."""
    cells = read_cells(spark, path)
    names = [r.col_name for r in cells.where("col_name IS NOT NULL").select("col_pos", "col_name").distinct().orderBy("col_pos").collect()]
    if not names:
        return spark.createDataFrame([], T.StructType([T.StructField("row_index", T.IntegerType())]))
    picked = [F.max(F.when(F.col("col_name") == n, F.col("value"))).alias(n) for n in names]
    return cells.groupBy("row_index").agg(*picked)


def parse(spark: SparkSession, path: str, normalized: bool = True) -> DataFrame:
    """row_index and the template's columns (or the raw ones) of a file."""
    raw = read_raw(spark, path)
    return normalize.normalize(raw, keep=["row_index"]) if normalized else raw


def mapping_report(spark: SparkSession, path: str) -> dict:
    return headers.mapping_report([c for c in read_raw(spark, path).columns if c != "row_index"])


def export_format(path: str, fmt: str | None = None) -> tuple[str, str]:
    """(path, format): by suffix, or csv with the suffix put in place of an unknown one."""
    by_suffix = {".csv": "csv", ".tsv": "csv", ".xlsx": "excel", ".xls": "excel", ".json": "json"}
    if fmt is not None:
        if fmt not in ("csv", "excel", "json"):
            raise ValueError(f"unknown format {fmt}")
        return path, fmt
    stem, dot, suffix = path.rpartition(".")
    known = by_suffix.get(f".{suffix.lower()}") if dot else None
    return (path, known) if known else (f"{stem if dot and '/' not in suffix else path}.csv", "csv")


def _xlsx(path: str, columns: list[str], rows: Iterator[list[str]]) -> None:
    """Rows go into the sheet's entry of the archive as they come."""
    from xml.sax.saxutils import escape

    line = lambda i, r: f'<row r="{i}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in r) + "</row>"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    main, rel = _NS.strip("{}"), _REL.strip("{}")
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="BOM" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, head + xml)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            for i, r in enumerate(itertools.chain([columns], rows), 1):
                sheet.write(line(i, r).encode())
            sheet.write(b"</sheetData></worksheet>")


def export(rows: DataFrame, path: str, fmt: str | None = None, order: str = "row_index") -> str:
    """Rows as one local file, streamed through the driver partition by partition; returns its path.

    The template's columns in their order if the frame has nothing else, sorted columns otherwise. CSV is UTF-8 with
    commas and CRLF, for .tsv too.
    """
    path, fmt = export_format(path, fmt)
    rows = rows.orderBy(order) if order in rows.columns else rows
    names = [c for c in rows.columns if c != order]
    columns = list(catalog.HEADERS) if set(names) <= set(catalog.HEADERS) else sorted(names)
    full = rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in columns])
    lines = ([*r] for r in full.toLocalIterator())
    first = next(lines, None)
    if first is None:
        raise ValueError("no rows to export")
    lines = (x for part in ([first], lines) for x in part)
    if fmt == "csv":
        with open(path, "w", encoding="utf-8", newline="") as f:
            csv.writer(f).writerows([columns])
            csv.writer(f).writerows(lines)
    elif fmt == "excel":
        _xlsx(path, columns, lines)
    else:
        with open(path, "w", encoding="utf-8") as f:
            for i, x in enumerate(lines):
                f.write(("[\n" if i == 0 else ",\n") + textwrap.indent(json.dumps(dict(zip(columns, x, strict=True)), indent=2, ensure_ascii=False), "  "))
            f.write("\n]")
    return path


def parse_and_export(spark: SparkSession, source: str, target: str, fmt: str | None = None) -> str:
    return export(parse(spark, source), target, fmt)


def write_many(rows: DataFrame, folder: str, fmt: str = "csv") -> None:
    """The scalable sink: a folder of part files, written by the executors."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(folder) if fmt == "csv" else writer.json(folder)


def jdbc_url(host: str | None = None, database: str | None = None, port: int = 5432, user: str | None = None, password: str | None = None, kind: str = "postgresql") -> tuple[str, dict[str, str]]:
    """(URL, options) of a database from its parts; what isn't given is read from DB_HOST, DB_NAME, DB_PORT, DB_USER and
    DB_PASSWORD. A database needs a host, a name, a user and a password."""
    env = os.environ
    host, database, user, password = host or env.get("DB_HOST"), database or env.get("DB_NAME"), user or env.get("DB_USER"), password or env.get("DB_PASSWORD")
    lacking = [n for n, x in (("host", host), ("database", database), ("user", user), ("password", password)) if not x]
    if lacking:
        raise ValueError(f"the database's {', '.join(lacking)} must be given")
    return f"jdbc:{kind}://{host}:{env.get('DB_PORT') or port}/{database}", {"user": user, "password": password}


def jdbc_table(spark: SparkSession, url: str | None, table: str, **options: str) -> DataFrame:
    """A table of an existing database, by Spark's JDBC source; the driver class must be on the class path."""
    if not url:
        raise ValueError("a JDBC URL is needed")
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(rows: DataFrame, url: str | None, table: str, batch: int = 10_000, **options: str) -> None:
    """Append rows to a table of a database, a transaction a partition; maps go as JSON text."""
    if not url:
        raise ValueError("a JDBC URL is needed")
    maps = {f.name: F.to_json(f.name) for f in rows.schema.fields if isinstance(f.dataType, T.MapType)}
    rows.withColumns(maps).write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode("append").save()
