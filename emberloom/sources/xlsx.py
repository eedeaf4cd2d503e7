"""Goods lists kept as workbooks: sheets are read as rows on the executors, then codes are united for each name and class."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Words by which a sheet's header row and its columns are known.
NAME_WORDS, CLASS_WORDS, CODE_WORDS = ("명칭", "상품", "name"), ("류", "class"), ("유사군", "코드", "code")
#: Rows in which a header is looked for.
HEADER_ROWS = 20


def cells(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(sheet name, rows of cell texts) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for entry in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in entry.iter(f"{_MAIN}t")))
        sheets = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for title, file in zip(sheets, files):
            rows = []
            for row in ElementTree.fromstring(book.read(file)).iter(f"{_MAIN}row"):
                out: list[str] = []
                for cell in row:
                    place = 0
                    for letter in re.match("[A-Z]*", cell.get("r") or "")[0]:
                        place = place * 26 + ord(letter) - 64
                    out += [""] * (place - 1 - len(out))
                    value = cell.find(f"{_MAIN}v")
                    text = value.text or "" if value is not None else "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    out.append(shared[int(text)] if cell.get("t") == "s" and text else text)
                rows.append(out)
            yield title, rows


def goods_rows(sheet: str, rows: list[list[str]]) -> Iterator[tuple[str, int, list[str]]]:
    """(name, class, codes) of a sheet: columns by its header, the class else by the sheet's name, codes by their pattern, else by separators."""
    def place(row: list[str], words: tuple[str, ...]) -> int | None:
        return next((k for k, c in enumerate(row) if any(w in c.lower() for w in words)), None)

    head = next((k for k, r in enumerate(rows[:HEADER_ROWS]) if place(r, NAME_WORDS) is not None and place(r, CODE_WORDS) is not None), None)
    if head is None:
        return
    name, code, of_class = (place(rows[head], w) for w in (NAME_WORDS, CODE_WORDS, CLASS_WORDS))
    by_sheet = re.findall(r"\d+", sheet)
    for row in rows[head + 1 :]:
        get = lambda k: row[k].strip() if k is not None and k < len(row) else ""  # noqa: B023, E731
        number = re.findall(r"\d+", get(of_class)) or by_sheet
        found = re.findall(r"[GS]\d{4,6}", get(code).upper()) or [c for c in re.split(r"[,;/\s]+", get(code)) if c]
        if get(name) and number and found:
            yield get(name), int(number[0]), found


def goods_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """goods_name, nice_class, codes (sorted union over all sheets and files); a workbook is read by one task."""
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [r for data in frame["content"] for sheet, rows in cells(data) for r in goods_rows(sheet, rows)]
            yield pd.DataFrame(found, columns=["goods_name", "nice_class", "codes"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "goods_name string, nice_class int, codes array<string>")
    return rows.select("goods_name", "nice_class", F.explode("codes").alias("code")).groupBy("goods_name", "nice_class").agg(F.array_sort(F.collect_set("code")).alias("codes"))
