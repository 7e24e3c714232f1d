"""Files: resumes of several formats as text, whole texts, and configuration."""
from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Fixed values, used when neither a given nor a default configuration is there.
BUILT_IN_CONFIG = {"fields": [{"path": "full_name"}, {"path": "emails"}, {"path": "skills"}], "on_missing": "null"}


def docx_text(content: bytes) -> str:
    """The text of the body's paragraphs, joined by newlines; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        body = ElementTree.fromstring(file.read("word/document.xml")).find(f"{WORD}body")
    out = []
    for paragraph in body.findall(f"{WORD}p"):
        parts = []
        for node in paragraph.iter():
            if node.tag == f"{WORD}t":
                parts.append(node.text or "")
            elif node.tag == f"{WORD}tab":
                parts.append("\t")
            elif node.tag in (f"{WORD}br", f"{WORD}cr"):
                parts.append("\n")
        out.append("".join(parts))
    return "\n".join(out)


def json_text(content: bytes) -> str:
    """A JSON object as one line of text, anything else as its Python text."""
    data = json.loads(content.decode("utf-8"))
    return json.dumps(data) if isinstance(data, dict) else str(data)


def pdf_text(content: bytes) -> str:
    """Pages' texts, each followed by a newline; needs the optional library pdfplumber."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return "".join((page.extract_text() or "") + "\n" for page in pdf.pages)


EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    "docx": docx_text,
    "pdf": pdf_text,
    "json": json_text,
    "txt": lambda content: content.decode("utf-8"),
    "md": lambda content: content.decode("utf-8"),
}


def read_resumes(spark: SparkSession, path: str, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(candidate_key, path, ext, text, error) of the files that ``path`` names.

    The key is the file's name without its extension. The format goes by the lower-cased extension; an unknown one, or a file
    that can't be read, has a null text and an error.
    """
    known = EXTRACTORS | (extractors or {})

    @F.pandas_udf("text string, error string")
    def extract(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
        texts, errors = [], []
        for kind, raw in zip(ext, content, strict=True):
            text = error = None
            if kind in known:
                try:
                    text = known[kind](raw)
                except Exception as fault:  # any damage to a file only concerns its row
                    error = f"{type(fault).__name__}: {fault}"
            else:
                error = f"Unsupported resume format: .{kind}"
            texts.append(text)
            errors.append(error)
        return pd.DataFrame({"text": texts, "error": errors}, dtype="object")

    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^.]*)?$", 1)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    read = files.select(name.alias("candidate_key"), "path", ext.alias("ext"), "content").withColumn("got", extract("ext", "content"))
    return read.select("candidate_key", "path", "ext", "got.text", "got.error")


def read_texts(spark: SparkSession, path: str, name: str = "text") -> DataFrame:
    """(candidate_key, whole text) of the files that ``path`` names."""
    files = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return files.select(F.regexp_extract("file", r"^(.+?)(?:\.[^.]*)?$", 1).alias("candidate_key"), F.col("value").alias(name))


def load_config(path: str | None = None, default: str | None = None, strict: bool = False) -> dict:
    """A projection configuration: the given file, else the default one, else the built-in; ``strict`` wants the given one."""
    for at in (path, default):
        if at and os.path.exists(at):
            with open(at, encoding="utf-8") as file:
                return json.load(file)
        if strict:
            raise FileNotFoundError(f"Config file {at} not found")
    return BUILT_IN_CONFIG
