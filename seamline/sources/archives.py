"""Binary sources: EPUB books and zipped UIMA XMI annotations, read with ``binaryFile`` and parsed in batches."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.labels import html_text

_SPANS = "path string, kind string, begin int, end int, text string, scene_type string, features string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def epub_pages(content: bytes) -> list[str]:
    """The HTML files of a book in reading order: the package's spine, else all of them by name."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = book.namelist()
    try:
        box = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in box.iter() if _local(e.tag) == "rootfile")
        tree = ElementTree.fromstring(book.read(package))
        where = {e.get("id"): e.get("href") for e in tree.iter() if _local(e.tag) == "item"}
        folder = posixpath.dirname(package)
        order = [posixpath.normpath(posixpath.join(folder, where[e.get("idref")])) for e in tree.iter() if _local(e.tag) == "itemref" and e.get("idref") in where]
        order = [n for n in order if n in names]
    except (KeyError, StopIteration, ElementTree.ParseError):
        order = []
    order = order or sorted(n for n in names if n.lower().endswith((".html", ".xhtml", ".htm")))
    return [book.read(n).decode("utf-8", "replace") for n in order]


def epub_texts(files: DataFrame) -> DataFrame:
    """(path, page, text): the text of each page of each book (path, content); markup is stripped by column expressions."""

    def run(batches):
        for pdf in batches:
            rows = [(p, k, h) for p, c in zip(pdf["path"], pdf["content"]) for k, h in enumerate(epub_pages(c))]
            yield pd.DataFrame(rows, columns=["path", "page", "html"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, html string").select("path", "page", html_text("html").alias("text"))


def read_epub(spark: SparkSession, path) -> DataFrame:
    return epub_texts(spark.read.format("binaryFile").load(path))


def write_epub(pages: list[tuple[str, str]]) -> bytes:
    """A book of (file name, HTML) pages in reading order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="{name}"/>' for k, (name, _) in enumerate(pages))
        z.writestr("o/p.opf", f"<package><manifest>{items}</manifest><spine>{''.join(f'<itemref idref=%si{k}%s/>' % (chr(34), chr(34)) for k in range(len(pages)))}</spine></package>")
        for name, html in sorted(pages):
            z.writestr(f"o/{name}", html)
    return out.getvalue()


def xmi_spans(content: bytes, scene_types: tuple[str, ...] = ("Scene",)) -> list[tuple]:
    """(kind, begin, end, text, scene_type, features) of sentences and scenes in an XMI file, plain or zipped;
    sentences without text are dropped, their white space is collapsed."""
    if content[:2] == b"PK":
        box = zipfile.ZipFile(io.BytesIO(content))
        content = box.read(next(n for n in box.namelist() if n.endswith(".xmi")))
    tree = ElementTree.fromstring(content)
    text = next((e.get("sofaString") or "" for e in tree.iter() if _local(e.tag) == "Sofa"), "")
    out = []
    for e in tree.iter():
        kind = _local(e.tag)
        if kind not in ("Sentence", "Scene"):
            continue
        begin, end = int(e.get("begin")), int(e.get("end"))
        if kind == "Sentence":
            if plain := " ".join(text[begin:end].split()):
                out.append(("sentence", begin, end, plain, None, None))
        elif not scene_types or e.get("sceneType", "Scene") in scene_types:
            out.append(("scene", begin, end, None, e.get("sceneType", "Scene"), e.get("features")))
    return sorted(out, key=lambda r: (r[0], r[1], r[2]))


def xmi_rows(files: DataFrame, scene_types: tuple[str, ...] = ("Scene",)) -> DataFrame:
    """Sentence and scene spans of XMI files (path, content); no ``scene_types``: spans of all types."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"]) for r in xmi_spans(c, scene_types)]
            yield pd.DataFrame(rows, columns=["path", "kind", "begin", "end", "text", "scene_type", "features"])

    return files.select("path", "content").mapInPandas(run, _SPANS)


def read_xmi(spark: SparkSession, path, scene_types: tuple[str, ...] = ("Scene",)) -> DataFrame:
    return xmi_rows(spark.read.format("binaryFile").load(path), scene_types)


def scene_features(features: str | None, known: tuple[str, ...]) -> tuple[int | None, list[str]]:
    """(scene index, known reason tags) of a scene's features: a JSON object whose ``reason`` is a comma list."""
    try:
        reason = json.loads(features or "{}").get("reason") or ""
    except (ValueError, AttributeError):
        reason = ""
    parts = [p.strip().lower() for p in str(reason).split(",")]
    number = next((int(p) for p in parts if re.fullmatch(r"\d+", p)), None)
    return number, [p for p in parts if p in known]


def write_xmi(text: str, sentences: list[tuple[int, int]], scenes: list[tuple[int, int, str]]) -> bytes:
    """A zipped XMI file, for tests and exchange."""
    root = ElementTree.Element("XMI")
    for b, e in sentences:
        ElementTree.SubElement(root, "Sentence", begin=str(b), end=str(e))
    for b, e, kind in scenes:
        ElementTree.SubElement(root, "Scene", begin=str(b), end=str(e), sceneType=kind)
    ElementTree.SubElement(root, "Sofa", sofaString=text)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("doc.xmi", ElementTree.tostring(root))
    return out.getvalue()
