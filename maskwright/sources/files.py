"""Text of office files, read with the binaryFile source, and the status of a scan."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits in bytes, characters and unpacked bytes.
MAX_BYTES, MAX_CHARS, MAX_UNPACKED = 25 * 2**20, 150_000, 200 * 2**20
# Formats by extension and by media type.
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "docm": "docx", "dotx": "docx", "dotm": "docx", "xlsx": "xlsx", "xlsm": "xlsx", "xltx": "xlsx", "xltm": "xlsx", "pptx": "pptx", "pptm": "pptx", "potx": "pptx", "potm": "pptx", "ppsx": "pptx", "ppsm": "pptx"}
MEDIA = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.ms-word.document.macroenabled.12": "docx",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.template": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-excel.sheet.macroenabled.12": "xlsx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.template": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.ms-powerpoint.presentation.macroenabled.12": "pptx",
    "application/vnd.openxmlformats-officedocument.presentationml.slideshow": "pptx",
    "application/vnd.openxmlformats-officedocument.presentationml.template": "pptx",
}
_MAIN = {"docx": r"word/document\.xml", "pptx": r"ppt/presentation\.xml|ppt/slides/slide\d+\.xml", "xlsx": r"xl/workbook\.xml|xl/worksheets/sheet\d+\.xml"}
_ENTITY = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
#: Extractors of further formats (pdf needs a library of the user's choice): bytes to text.
PROVIDERS: dict[str, Callable[[bytes], str]] = {}


def format_of(name: Column, media: Column | None = None) -> Column:
    """The scannable format of a file by its name's extension, else by its media type, or null."""
    table = lambda kinds: F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    by_name = table(EXTENSIONS)[F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))]
    return by_name if media is None else F.coalesce(by_name, table(MEDIA)[F.lower(media)])


def entities(text: str) -> str:
    """XML entities decoded; invalid ones stay."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name in _ENTITY:
            return _ENTITY[name]
        try:
            n = int(name[2:], 16) if name[:2] in ("#x", "#X") else int(name[1:])
            return m[0] if 0xD800 <= n < 0xE000 else chr(n)
        except ValueError:
            return m[0]

    return re.sub(r"&(#[xX][0-9A-Fa-f]+|#\d+|\w+);", one, text)


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def _runs(xml: str, mark: str) -> str:
    """Text of w:t (also deleted) or a:t runs; paragraphs end lines, cells and tabs are tabs, breaks are line ends."""
    out = []
    for m in re.finditer(rf"<{mark}:(?:t|delText)(?:\s[^>]*)?>([^<]*)</{mark}:(?:t|delText)>|<({mark}:tab|{mark}:br|{mark}:cr)\b[^>]*/>|</({mark}:p|{mark}:tc)>", xml, re.S):
        if m[1] is not None:
            out.append(entities(m[1]))
        else:
            out.append({"tab": "\t", "tc": "\t"}.get((m[2] or m[3]).split(":")[1], "\n"))
    return "".join(out)


def _numbered(names: list[str], pattern: str) -> list[str]:
    """Part names of a pattern with one number, by that number."""
    found = [(int(m[1] or 0), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _strings(xml: str) -> str:
    """Text of the runs of a shared or inline string or a cell comment, without phonetic guides."""
    return "".join(map(entities, re.findall(r"<t(?:\s[^>]*)?>([^<]*)</t>", re.sub(r"<rPh\b.*?</rPh>", "", xml, flags=re.S))))


def _comment(xml: str, tag: str) -> str:
    """Texts of a comment part's plain text elements, a line each."""
    return "\n".join(map(entities, re.findall(rf"<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", xml)))


def _sheet(xml: str, shared: list[str]) -> str:
    lines = []
    for row in re.findall(r"<row\b[^>]*>(.*?)</row>", xml, re.S):
        cells = []
        for attrs, body in re.findall(r"<c\b([^>]*?)(?:/>|>(.*?)</c>)", row, re.S):
            kind = re.search(r'\bt="(\w+)"', attrs)
            value = re.search(r"<v(?:\s[^>]*)?>([^<]*)</v>", body)
            if kind and kind[1] == "s":
                at = value[1].strip() if value else ""
                cells.append(shared[int(at)] if at.isdecimal() and int(at) < len(shared) else "")
            elif kind and kind[1] == "inlineStr":
                cells.append(_strings(body))
            elif value:
                cells.append(entities(value[1]))
        lines.append("\t".join(c for c in cells if c.strip()))
    return "\n".join(x for x in lines if x)


def office_text(data: bytes, kind: str) -> tuple[str, str | None]:
    """Status (scanned, no-text, encrypted, too-large, corrupt, unreadable) and text of a file."""
    if kind in PROVIDERS:
        text = tidy(PROVIDERS[kind](data))
        return ("scanned" if text else "no-text"), text
    if kind not in ("docx", "pptx", "xlsx"):
        return "unreadable", None
    if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return "encrypted", None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if sum(x.file_size for x in z.infolist()) > MAX_UNPACKED:
                return "too-large", None
            parts = {n: z.read(n).decode("utf-8", "replace") for n in z.namelist() if n.endswith(".xml")}
    except (zipfile.BadZipFile, OSError, RuntimeError):
        return "corrupt", None
    names, out = [*parts], []
    if not any(re.fullmatch(_MAIN[kind], n) for n in names):
        return "corrupt", None
    if kind == "docx":
        order = [n for n in names if n == "word/document.xml"] + [n for p in (r"word/glossary/document()\.xml", r"word/header(\d*)\.xml", r"word/footer(\d*)\.xml", r"word/footnotes()\.xml", r"word/endnotes()\.xml", r"word/comments()\.xml") for n in _numbered(names, p)]
        out = [_runs(parts[n], "w") for n in order]
    elif kind == "pptx":
        order = [n for p in (r"ppt/slides/slide(\d+)\.xml", r"ppt/notesSlides/notesSlide(\d+)\.xml", r"ppt/charts/chart(\d+)\.xml") for n in _numbered(names, p)]
        out = [_runs(parts[n], "a") for n in order]
        # older comments have plain text, newer ones paragraphs
        out += [f"{_comment(parts[n], 'p:text')}\n{_runs(parts[n], 'a')}" for n in sorted(names) if re.fullmatch(r"ppt/comments/[^/]+\.xml", n)]
    else:
        shared = [_strings(x) for x in re.findall(r"<si\s*/>|<si(?:\s[^>]*)?>(.*?)</si>", parts.get("xl/sharedStrings.xml", ""), re.S)]
        out = [_sheet(parts[n], shared) for n in _numbered(names, r"xl/worksheets/sheet(\d+)\.xml")]
        out += [_runs(parts[n], "a") for n in _numbered(names, r"xl/charts/chart(\d+)\.xml")]
        out += [_strings(parts[n]) or _comment(parts[n], "text") for n in sorted(names) if re.fullmatch(r"xl/(comments\d*|threadedComments/[^/]+)\.xml", n)]
    for part, tags in (("docProps/core.xml", "creator|lastModifiedBy|title|subject|keywords|description|category"), ("docProps/app.xml", "Company|Manager")):
        out += [entities(v) for _, v in re.findall(rf"<(?:\w+:)?({tags})(?:\s[^>]*)?>(.*?)</", parts.get(part, ""), re.S)]
    text = tidy("\n".join(x for x in out if x.strip()))
    return ("scanned" if text else "no-text"), text


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """path, format, status, text (at most MAX_CHARS characters) and truncated of the files below a path.

    Files over the size limit keep their row, and their content is not passed on.
    """
    files = spark.read.format("binaryFile").load(path)
    # the content of files over the limit is not read
    small = files.filter(F.col("length") <= MAX_BYTES).select("path", "content")
    files = small.unionByName(files.filter(F.col("length") > MAX_BYTES).select("path", F.lit(None).cast("binary").alias("content")))
    kind = format_of(F.col("path"))

    @F.pandas_udf("status string, text string")
    def extract(data: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([("unreadable", None) if k is None else ("too-large", None) if d is None else office_text(bytes(d), k) for d, k in zip(data, kinds, strict=True)], columns=["status", "text"])

    found = files.select("path", kind.alias("format"), F.col("content").alias("data")).select("path", "format", extract("data", "format").alias("x"))
    return found.select("path", "format", F.col("x.status").alias("status"), F.substring("x.text", 1, MAX_CHARS).alias("text"), (F.length("x.text") > MAX_CHARS).alias("truncated"))
