"""Folders of HTML files as tables, and tables as HTML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions import arrow, rx, scalar
from linewright.sources import sink

# The page template and the spans that it lets through.
KEPT_SPAN = "<span style=\"(?:color:[^\"]*|display:\\s*none;?\\s*)\">|</span>"
PRE = "(?i)<pre>([\\s\\S]*?)</pre>"
HEAD = "(?i)<head\\b[^>]*>[\\s\\S]*?</head>"
FONTS = "'MS PGothic', 'Meiryo', monospace"


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, value) of the files that end in .html, in any case."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
    return files.filter(F.lower("file_name").endswith(".html"))


def pre_text(page: Column) -> Column:
    """The unescaped text of the first pre element; null without one."""
    return arrow.unescape_html(F.when(page.rlike(PRE), F.regexp_extract(page, PRE, 1)))


def imported_text(page: Column) -> Column:
    """The pre element's text, or the whole file's."""
    return F.coalesce(pre_text(page), arrow.unescape_html(page))


def head(page: Column) -> Column:
    return F.regexp_substr(page, F.lit(HEAD))


def background(page: Column) -> Column:
    """The background colour that the style gives the body; null without one."""
    return F.nullif(F.regexp_extract(page, "(?i)body\\s*\\{[^}]*background-color\\s*:\\s*([^;}\\s]+)", 1), F.lit(""))


def escape_body(text: Column) -> Column:
    """Everything escaped but the spans for colours and hidden parts."""

    def build(z: Column) -> Column:
        tail = F.transform(z["hits"], lambda hit, i: F.concat(hit, scalar.escape_html(F.get(z["gaps"], i + 1))))
        return F.concat(scalar.escape_html(F.get(z["gaps"], F.lit(0))), F.array_join(tail, ""))

    both = F.struct(F.split(text, KEPT_SPAN, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(KEPT_SPAN), F.lit(0)).alias("hits"))
    return rx.let(both, build)


def page(text: Column, color: Column, head_html: Column | None = None, family: str = "") -> Column:
    """A whole page around a text; a head of its own is kept, unless a font family is to be embedded when it is written."""
    rule, fonts = (f"        {sink.FONT_MARK}\n", f"'{family}', {FONTS}") if family else ("", FONTS)
    made = F.concat(
        F.lit("<head>\n    <meta charset=\"UTF-8\">\n    <title>Translated</title>\n    <style>\n" + rule + "        body { background-color: "), color,
        F.lit("; color: #000; padding: 20px; }\n        pre {\n            font-family: " + fonts + ";\n            font-size: 16px;\n            line-height: 1.2;\n            white-space: pre;\n            word-wrap: normal;\n        }\n    </style>\n</head>"),
    )
    top = made if head_html is None or family else F.coalesce(head_html, made)
    return F.concat(F.lit("<!DOCTYPE html>\n<html lang=\"zh-TW\">\n"), top, F.lit("\n<body>\n<pre>"), escape_body(text), F.lit("</pre>\n</body>\n</html>"))


def write_folder(pages: DataFrame, path: str, existing: str = "replace", font: str | None = None, family: str = "") -> None:
    """One file of its own name for each (file_name, value), in a folder that the executors share.

    Names get the suffix .html where they lack it; of rows that share one the greatest value
    stays, and a null value is not written. All files appear when all tasks are done, none if
    one fails. ``existing`` says what becomes of files already there: replace, keep or error.
    A font file goes into pages that ``page`` made for its family.
    """
    spark = pages.sparkSession
    name = F.when(F.lower("file_name").endswith(".html"), F.col("file_name")).otherwise(F.concat("file_name", F.lit(".html")))
    rows = pages.filter("value IS NOT NULL AND file_name IS NOT NULL").select(name.alias("file_name"), "value")
    sink.write(rows, path, existing=existing, family=family, **({"font": sink.uri(spark, font)} if font else {}))


def font_face(spark: SparkSession, path: str, family: str) -> DataFrame:
    """A font file as an embedded @font-face rule: (path, css)."""
    kind = F.when(F.lower("path").endswith(".otf"), "font/otf").when(F.lower("path").endswith(".woff2"), "font/woff2").otherwise("font/ttf")
    css = F.concat(F.lit("@font-face { font-family: '" + family + "'; src: url(data:"), kind, F.lit(";base64,"), F.base64("content"), F.lit("); }"))
    return spark.read.format("binaryFile").load(path).select("path", css.alias("css"))
