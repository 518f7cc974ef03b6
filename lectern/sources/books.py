"""Book files as rows: EPUB, FB2, CBZ and plain HTML into one table of sections.

Files are read by Spark (`binaryFile`); each task opens the archives of its own rows with
the standard library and emits flat rows, so the rest of the work stays in columns. A
damaged file gives one row with an error and no section.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions.text import book_format

SECTIONS = "book string, format string, title string, author string, spine int, href string, label string, html string, error string"
#: Archives larger than this, unpacked, are refused.
MOST_BYTES = 512 * 1024 * 1024


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, format, content of the book files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return raw.withColumn("format", book_format(F.col("path"))).where("format is not null")


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _first(root: ET.Element, name: str) -> ET.Element | None:
    return next((e for e in root.iter() if _local(e) == name), None)


def _said(e: ET.Element | None) -> str | None:
    return " ".join("".join(e.itertext()).split()) or None if e is not None else None


def _archive(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
        raise ValueError("archive too large")
    return z


def epub(data: bytes) -> tuple[str | None, str | None, list[tuple[str, str | None, str]]]:
    """Title, author and sections (href, label from the contents, html) in spine order."""
    z = _archive(data)
    package = next(e.get("full-path") for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if _local(e) == "rootfile")
    root, base = ET.fromstring(z.read(package)), posixpath.dirname(package)
    at = lambda href: posixpath.normpath(posixpath.join(base, href))
    items = {e.get("id"): e for e in root.iter() if _local(e) == "item"}
    labels: dict[str, str] = {}
    for e in items.values():
        nav, ncx = "nav" in (e.get("properties") or "").split(), e.get("media-type") == "application/x-dtbncx+xml"
        if not (nav or ncx) or (ncx and labels):
            continue
        tree, here = ET.fromstring(z.read(at(e.get("href")))), posixpath.dirname(at(e.get("href")))
        for link in tree.iter():
            href = link.get("href") if nav and _local(link) == "a" else None
            text = _said(link)
            if ncx and _local(link) == "navPoint":
                content = _first(link, "content")
                href, text = content.get("src") if content is not None else None, _said(_first(link, "text"))
            if href and text:
                labels.setdefault(posixpath.normpath(posixpath.join(here, href.partition("#")[0])), text)
    sections = []
    for ref in (e for e in root.iter() if _local(e) == "itemref"):
        href = at(items[ref.get("idref")].get("href"))
        sections.append((href, labels.get(href), z.read(href).decode("utf-8", "replace")))
    return _said(_first(root, "title")), _said(_first(root, "creator")), sections


def fb2(data: bytes) -> tuple[str | None, str | None, list[tuple[str, str | None, str]]]:
    """Title, author and top-level sections, as simple HTML."""
    if data[:2] == b"PK":
        z = _archive(data)
        data = z.read(next(n for n in z.namelist() if n.lower().endswith(".fb2")))
    root = ET.fromstring(data)
    info = _first(root, "title-info")
    author = _first(info, "author") if info is not None else None
    out = []

    def html(e: ET.Element, depth: int) -> str:
        inner = (e.text or "") + "".join(html(c, depth + (_local(c) == "section")) + (c.tail or "") for c in e)
        name = {"p": "p", "v": "p", "subtitle": "h3", "emphasis": "em", "strong": "strong", "cite": "blockquote"}.get(_local(e))
        if _local(e) == "title":
            return f"<h{min(6, depth)}>{' '.join(''.join(e.itertext()).split())}</h{min(6, depth)}>"
        return f"<{name}>{inner}</{name}>" if name else inner

    for body in (e for e in root if _local(e) == "body"):
        for s in (e for e in body if _local(e) == "section"):
            out.append((f"section-{len(out) + 1}", _said(_first(s, "title")), f"<body>{html(s, 1)}</body>"))
    return _said(_first(info, "book-title")) if info is not None else None, " ".join(filter(None, (_said(c) for c in author))) or None if author is not None else None, out


def cbz(data: bytes) -> tuple[str | None, str | None, list[tuple[str, str | None, str]]]:
    """Pictures in order of lower-case name, each a section with one image; title and writer from ComicInfo."""
    z = _archive(data)
    info = next((ET.fromstring(z.read(n)) for n in z.namelist() if n.lower().endswith("comicinfo.xml")), None)
    pictures = sorted((n for n in z.namelist() if re.search(r"(?i)\.(png|jpe?g|gif|webp)$", n)), key=str.lower)
    said = (lambda n: _said(_first(info, n))) if info is not None else (lambda n: None)
    return said("Title") or said("Series"), said("Writer"), [(n, None, f'<body><img src="{n}"/></body>') for n in pictures]


READERS = {"epub": epub, "fb2": fb2, "fbz": fb2, "cbz": cbz}


def sections(found: DataFrame) -> DataFrame:
    """Sections of the files (path, format, content): book is the SHA-256 of the file's bytes."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SECTIONS.split(", ")]
        for pdf in frames:
            for kind, data in zip(pdf["format"], pdf["content"], strict=True):
                book = hashlib.sha256(data).hexdigest()
                try:
                    title, author, parts = READERS[kind](bytes(data))
                    rows = [(book, kind, title, author, k, href, label, html, None) for k, (href, label, html) in enumerate(parts)]
                except Exception as e:  # a damaged file must not end the job; the row says what went wrong
                    rows = [(book, kind, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(rows, columns=names).astype({"spine": "Int32"})

    return found.where(F.col("format").isin(*READERS)).select("format", "content").mapInPandas(read, SECTIONS)


def write_shards(events: DataFrame, path: str) -> None:
    """Events as JSON lines in folders by device and month."""
    events.write.partitionBy("device", "month").mode("append").json(path)


def changed_only(rows: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Rows whose content hash differs from the published one (key, fingerprint)."""
    print_ = F.sha2(F.to_json(F.struct(*rows.columns)).cast("binary"), 256)
    known = published.select(key, F.col("fingerprint").alias("_f"))
    return rows.withColumn("fingerprint", print_).join(known, key, "left").where(F.col("_f").isNull() | (F.col("_f") != F.col("fingerprint"))).drop("_f")
