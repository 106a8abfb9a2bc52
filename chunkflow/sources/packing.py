"""Finished books as EPUB files, and tables as JSON for other tools.

A book is written from a stream of rows, its chapters and then its images, into a ZIP file entry by
entry; the lists that the format wants of them come last. So a task holds one chapter or image at a time.
"""

from __future__ import annotations

import io
import re
import unicodedata
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import BinaryIO
from urllib.parse import quote
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.arrays import in_batches
from ..functions.text import nav_title
from ..functions.xhtml import _ILLEGAL, clean, fragment
from ..operators.commits import split_chapters

#: Names fixed by the format.
XHTML, OPF, DC, OPS = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/", "http://www.idpf.org/2007/ops"
CONTAINER_NS, PAGE_TYPE, PACKAGE_TYPE = "urn:oasis:names:tc:opendocument:xmlns:container", "application/xhtml+xml", "application/oebps-package+xml"
PACKAGE, FOLDER, STYLE = "OEBPS/content.opf", "OEBPS", "book.css"
#: A row of the stream: the book itself (name: file, text: title), a chapter (name: title, text: markdown), an image.
BOOK_ROW, CHAPTER_ROW, IMAGE_ROW = 0, 1, 2
WRITTEN = "file_name string, path string, size long, entries array<struct<name:string,size:long,crc:long>>"


def _xml(root: ET.Element) -> bytes:
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def _add(to: ET.Element, tag: str, text: str | None = None, **attrs: str) -> ET.Element:
    out = ET.SubElement(to, tag, attrs)
    out.text = text
    return out


@lru_cache(1)
def _container() -> bytes:
    container = ET.Element("container", {"xmlns": CONTAINER_NS, "version": "1.0"})
    _add(_add(container, "rootfiles"), "rootfile", **{"full-path": PACKAGE, "media-type": PACKAGE_TYPE})
    return _xml(container)


@lru_cache(64)
def _frame(lang: str, styled: bool) -> tuple[bytes, bytes, bytes]:
    """What a page has before its title, between that and its body, and after it."""
    page = ET.Element("html", {"xmlns": XHTML, "xmlns:epub": OPS, "lang": lang, "xml:lang": lang})
    head = _add(page, "head")
    _add(head, "title")
    if styled:
        _add(head, "link", rel="stylesheet", href=STYLE, **{"type": "text/css"})
    _add(page, "body", "\n")
    start, _, end = _xml(page).rpartition(b"</body>")
    start, _, mid = start.rpartition(b"<title />")
    return start, mid, end


@lru_cache(8)
def _store(uri: str) -> tuple:
    """The file system of a URI and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class _EntryBuffer:
    """A ZIP file's end as a seekable file: the entry at hand stays in memory until it is let out."""

    def __init__(self, out: BinaryIO):
        self.out, self.base, self.held = out, 0, io.BytesIO()
        self.write, self.flush = (lambda data: self.held.write(data)), lambda: None

    def tell(self) -> int:
        return self.base + self.held.tell()

    def seek(self, at: int) -> int:
        return self.base + self.held.seek(at - self.base)

    def let_out(self) -> None:
        data = self.held.getvalue()
        self.out.write(data)
        self.base, self.held = self.base + len(data), io.BytesIO()


class EpubWriter:
    """An EPUB of chapters and images that are put in one after another."""

    def __init__(self, out: BinaryIO, title: str, lang: str, style: str = ""):
        self.buffer, self.lang, self.style = _EntryBuffer(out), lang, style
        self.title = _ILLEGAL.sub("", title).strip() or "Untitled"
        self.zip = zipfile.ZipFile(self.buffer, "w")
        self.listed: list[tuple[str, str, str, str, bool]] = []  # id, name, type, title, in the reading order
        self._put("mimetype", b"application/epub+zip", zipfile.ZIP_STORED)  # first and uncompressed
        self._put("META-INF/container.xml", _container())

    def _put(self, name: str, data: bytes, how: int = zipfile.ZIP_DEFLATED) -> None:
        self.zip.writestr(zipfile.ZipInfo(name), data, how)
        self.buffer.let_out()

    def _page(self, title: str, body: str) -> bytes:
        """A page around an XHTML fragment, which is put in as it is."""
        start, mid, end = _frame(self.lang, bool(self.style))
        # no title is an empty element
        head = b"<title>" + escape(title).encode("utf-8", "xmlcharrefreplace") + b"</title>" if title else b"<title />"
        return start + head + mid + body.encode() + b"\n</body>" + end

    def chapter(self, title: str, markdown: str) -> None:
        n = sum(x[4] for x in self.listed) + 1
        name, title = f"chapter-{n:03d}.xhtml", _ILLEGAL.sub("", title or self.title)
        self._put(f"{FOLDER}/{name}", self._page(title, fragment(markdown) or "<p></p>"))
        self.listed.append((f"text{n}", name, PAGE_TYPE, title, True))

    def image(self, href: str, kind: str, data: bytes) -> None:
        self._put(f"{FOLDER}/{href}", data)
        self.listed.append((f"image{len(self.listed)}", href, kind, "", False))

    def close(self) -> list[dict]:
        """Write the contents and the package; the entries, in order."""
        contents = ET.Element("ol")
        for _, name, _, title, read in self.listed:
            if read:
                _add(_add(contents, "li"), "a", title, href=name)
        body = f'<nav epub:type="toc" id="contents"><h1>{clean(self.title)}</h1>{ET.tostring(contents, encoding="unicode")}</nav>'
        self._put(f"{FOLDER}/nav.xhtml", self._page(self.title, body))
        if self.style:
            self._put(f"{FOLDER}/{STYLE}", self.style.encode())
        self._put(PACKAGE, self._package())
        self.zip.close()
        self.buffer.let_out()
        return [{"name": x.filename, "size": x.file_size, "crc": x.CRC} for x in self.zip.infolist()]

    def _package(self) -> bytes:
        words = re.findall(r"[\w-]+", unicodedata.normalize("NFKD", self.title), flags=re.A)
        root = ET.Element("package", {"xmlns": OPF, "xmlns:dc": DC, "version": "3.0", "unique-identifier": "book"})
        about = _add(root, "metadata")
        _add(about, "dc:identifier", f"urn:chunkflow:{'-'.join(words).lower()[:48] or 'book'}:{self.lang}", id="book")
        _add(about, "dc:title", self.title)
        _add(about, "dc:language", self.lang)
        manifest, spine = _add(root, "manifest"), _add(root, "spine")
        _add(manifest, "item", **{"id": "nav", "href": "nav.xhtml", "media-type": PAGE_TYPE, "properties": "nav"})
        _add(spine, "itemref", idref="nav", linear="no")
        if self.style:
            _add(manifest, "item", **{"id": "style", "href": STYLE, "media-type": "text/css"})
        for own, name, kind, _, read in self.listed:
            _add(manifest, "item", **{"id": own, "href": name, "media-type": kind})
            if read:
                _add(spine, "itemref", idref=own)
        return _xml(root)


def _stream(books: DataFrame, images: DataFrame, target_lang: str) -> DataFrame:
    """The rows of all books, a book's together and in order."""
    name = F.concat(F.regexp_replace("file_name", r"(?i)\.(?:epub|fb2\.zip|fb2|fbz)$", ""), F.lit(f".{target_lang}.epub"))
    nothing = F.lit(None).cast("binary")
    row = lambda role, no, name, kind, text, data: [F.col("book_id"), F.lit(role).alias("_role"), no.alias("_no"), name.alias("name"), kind.alias("kind"), text.alias("text"), data.alias("data")]
    none = F.lit(None).cast("string")
    rows = books.select(row(BOOK_ROW, F.lit(0), name, none, F.col("title"), nothing))
    chapters = split_chapters(books.select("book_id", "markdown"))
    rows = rows.unionByName(chapters.select(row(CHAPTER_ROW, F.col("chapter_no"), nav_title(F.col("title"), F.col("body")), none, F.col("body"), nothing)))
    rows = rows.unionByName(images.select(row(IMAGE_ROW, F.lit(0), F.col("href"), F.col("mime_type"), none, F.col("bytes"))))
    return rows.where("book_id is not null").repartition("book_id").sortWithinPartitions("book_id", "_role", "_no", "name")


def _pack(books: DataFrame, images: DataFrame, lang: str, style: str, columns: str, opened: Callable[[object, str], tuple[BinaryIO, Callable[[list[dict]], list]]]) -> DataFrame:
    """A row for each book: opened(book, file name) gives a file, and what its row is once the file is written."""
    schema = StructType([StructField("book_id", books.schema["book_id"].dataType), *StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        # one row at a time: a batch may hold many images
        rows = ([c[k].as_py() for c in b.columns] for b in batches for k in range(b.num_rows))
        for book, own in groupby(rows, lambda r: r[0]):
            _, role, _, name, _, title, _ = next(own)
            if role != BOOK_ROW:  # images without a book
                continue
            out, done = opened(book, name)
            epub = EpubWriter(out, title or "", lang, style)
            for _, role, _, name, kind, text, data in own:
                if role == CHAPTER_ROW:
                    epub.chapter(name, text or "")
                elif role == IMAGE_ROW and name and data is not None:
                    epub.image(name, kind or "application/octet-stream", data)
            yield (book, *done(epub.close()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(packed(batches), arrow)

    return _stream(books, images, lang).mapInArrow(run, schema)


def pack_books(books: DataFrame, images: DataFrame, target_lang: str, style: str = "") -> DataFrame:
    """books (book_id, file_name, title, markdown) -> book_id, file_name, epub.

    images (book_id, href, mime_type, bytes) are put in under their hrefs, so those that the text refers to
    (sources.books.used_images) are to be given. A finished book must fit a row; see write_books for larger ones.
    """

    def opened(book: object, name: str) -> tuple[BinaryIO, Callable[[list[dict]], list]]:
        out = io.BytesIO()
        return out, lambda _: [name, out.getvalue()]

    return _pack(books, images, target_lang, style, "file_name string, epub binary", opened)


def write_books(books: DataFrame, images: DataFrame, target_lang: str, path: str, style: str = "") -> DataFrame:
    """Books as files under a folder that executors share, each in a folder of its own: book_id and WRITTEN.

    The folder is a URI that pyarrow opens. A book is written under a name of its attempt and then given
    its own, so a task that is run again leaves one whole file. Memory is one chapter or image and a batch of rows.
    """
    uri = path if "://" in path else f"file://{path}" if path.startswith("/") else path
    uri = re.sub(r"^file:/(?!/)", "file:///", uri).rstrip("/")

    def opened(book: object, name: str) -> tuple[BinaryIO, Callable[[list[dict]], list]]:
        store, root = _store(uri)
        parts = quote(str(book), safe=""), (name or "").replace("/", "_")
        store.create_dir(f"{root}/{parts[0]}", recursive=True)
        draft = f"{root}/{parts[0]}/.{uuid.uuid4().hex}"
        out = store.open_output_stream(draft)

        def done(entries: list[dict]) -> list:
            size = out.tell()
            out.close()
            store.move(draft, f"{root}/{'/'.join(parts)}")
            return [name, f"{uri}/{quote(parts[0])}/{quote(parts[1])}", size, entries]

        return out, done

    return _pack(books, images, target_lang, style, WRITTEN, opened)


def write_requests(requests: DataFrame, path: str) -> None:
    """A request table as JSON lines."""
    requests.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def export_brief(guide: DataFrame, glossary: DataFrame, path: str) -> None:
    """The style guide and the glossary (rows with ord, src, dst) of each book as one JSON line."""
    terms = glossary.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ord", "src", "dst"))).alias("t"))
    entries = F.transform(F.coalesce("t", F.array()), lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst")))
    rows = guide.join(terms, "book_id", "left").select("book_id", "style_guide", entries.alias("glossary"))
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
