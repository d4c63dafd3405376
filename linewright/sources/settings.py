"""Settings and session caches as JSON files with fixed schemas, defaults and migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions import rx
from linewright.operators import glossary
from linewright.operators.extract import BASE, INVALID, SYMBOL

# The fields and their defaults.
SETTINGS = {"base_regex": BASE, "invalid_regex": INVALID, "symbol_regex": SYMBOL, "filter_text": "", "glossary": "", "glossary_temp": ""}
PATTERNS = ("base_regex", "invalid_regex", "symbol_regex")
CACHE_TEXT = {
    "source_text": "", "filter_text": "", "glossary_text": "", "glossary_text_temp": "", "doc_title": "", "doc_num": "1", "bg_color": "#ffffff",
    "fg_color": "#000000", "preview_text": "", "current_url": "", "batch_folder": "", "author_name": "", "editor_font_family": "MS PGothic",
    "last_open_dir": "", "editor_bg_color": "#ffffff", "embed_font_name": "monapo",
}
CACHE_NUMBER = {"editor_font_size": 12, "work_history_limit": 10, "fetch_history_limit": 50}
CACHE_FLAG = {"auto_copy": False, "author_only": False, "glossary_auto_search": True, "diff_save_mode": False, "editor_default_wysiwyg": False, "embed_font_in_html": False}
LINK = "struct<title:string,url:string,is_current:boolean>"


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, raw): each file's top-level values as JSON texts; a broken file has none."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
    return files.select("file_name", F.coalesce(F.from_json("value", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("raw"))


def _value(name: str) -> Column:
    return F.try_element_at("raw", F.lit(name))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """One row of settings for each file; missing values have their defaults."""
    return _raw(spark, path).select("file_name", *[F.coalesce(_value(k), F.lit(v)).alias(k) for k, v in SETTINGS.items()])


def write_settings(rows: DataFrame, path: str) -> None:
    rows.select(*SETTINGS).write.mode("overwrite").json(path)


def with_patterns(raw: DataFrame, patterns: DataFrame) -> DataFrame:
    """(file_name, raw) with the three patterns replaced and all else kept, unknown keys too."""
    joined = raw.join(patterns.select("file_name", *PATTERNS), "file_name")
    fresh = F.map_from_arrays(F.array(*[F.lit(p) for p in PATTERNS]), F.array(*PATTERNS))
    kept = F.map_filter("raw", lambda k, v: ~k.isin(*PATTERNS))
    return joined.select("file_name", F.map_concat(kept, fresh).alias("raw"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """One row of session state for each file, every field defaulted on its own.

    Related links are a map by url; an older flat list belongs to the current url. A
    missing limit of originals follows the limit of fetches.
    """
    rows = _raw(spark, path)
    texts = {k: F.coalesce(_value(k), F.lit(v)) for k, v in CACHE_TEXT.items()}
    for k in ("source_text", "filter_text", "glossary_text", "glossary_text_temp"):
        texts[k] = F.regexp_replace(texts[k], "\\n+\\z", "")
    numbers = {k: F.coalesce(_value(k).try_cast("int"), F.lit(v)) for k, v in CACHE_NUMBER.items()}
    numbers["original_cache_limit"] = F.coalesce(_value("original_cache_limit").try_cast("int"), numbers["fetch_history_limit"])
    flags = {k: F.coalesce(_value(k).try_cast("boolean"), F.lit(v)) for k, v in CACHE_FLAG.items()}
    by_url = F.from_json(_value("url_related_links"), f"map<string,array<{LINK}>>")
    flat = F.from_json(_value("url_related_links"), f"array<{LINK}>")
    is_list = F.coalesce(_value("url_related_links").startswith("["), F.lit(False))
    related = F.when(is_list & (texts["current_url"] != ""), F.map_from_arrays(F.array(texts["current_url"]), F.array(flat))).when(~is_list, by_url)
    histories = {
        "url_history": F.from_json(_value("url_history"), "array<struct<url:string,title:string>>"),
        "work_history": F.from_json(_value("work_history"), "array<struct<title:string,author:string>>"),
    }
    columns = texts | numbers | flags | {"url_related_links": related} | {k: F.coalesce(v, F.array().cast(_kind(k))) for k, v in histories.items()}
    return rows.select("file_name", *[c.alias(k) for k, c in columns.items()])


def _kind(name: str) -> str:
    return "array<struct<url:string,title:string>>" if name == "url_history" else "array<struct<title:string,author:string>>"


def update_links(links: Column, url: Column, fresh: Column) -> Column:
    """A map of links by url with one url's links replaced."""
    kept = F.map_filter(F.coalesce(links, F.create_map().cast(f"map<string,array<{LINK}>>")), lambda k, v: k != url)
    return F.map_concat(kept, F.map_from_arrays(F.array(url), F.array(fresh)))


#: Where a session keeps what a settings file calls otherwise.
SESSION_NAMES = {"filter_text": "filter_text", "glossary": "glossary_text", "glossary_temp": "glossary_text_temp"}


def with_values(value: Column, fresh: Column) -> Column:
    """A JSON object with a struct's fields put in; all else is kept as it is, unknown keys too. A broken one is empty."""
    kind = "map<string,variant>"
    put = F.from_json(F.to_json(fresh, {"ignoreNullFields": "false"}), kind)
    kept = F.map_filter(F.coalesce(F.from_json(value, kind), F.from_json(F.lit("{}"), kind)), lambda k, v: ~F.array_contains(F.map_keys(put), k))
    return F.to_json(F.map_concat(kept, put))


def _lines(rows: DataFrame, text: str) -> DataFrame:
    """(file_name, pos, line) of a text column; no line ends the text."""
    whole = F.regexp_replace(text, "\\R\\z", "")
    return rows.filter(F.col(text) != "").select("file_name", F.posexplode(F.split(whole, "\\R", -1)).alias("pos", "line"))


def exported(files: DataFrame, session: DataFrame, merge: bool = True) -> DataFrame:
    """(file_name, value): settings files with a session's state put in, keys of others kept.

    ``files`` are (file_name, value) as they are, or none of that name; ``session`` has what
    ``read_cache`` gives and the three patterns. With ``merge`` rules and glossaries of the
    file stay, and those of the session are merged into them by line and by key.
    """
    state = session.select("file_name", *PATTERNS, *[rx.strip(F.col(mine)).alias(name) for name, mine in SESSION_NAMES.items()])
    if merge:
        old = files.select("file_name", F.from_json("value", "map<string,string>").alias("raw")).join(state.select("file_name"), "file_name", "left_semi")
        for name in SESSION_NAMES:
            known = old.select("file_name", F.coalesce(_value(name), F.lit("")).alias(name))
            how = glossary.merge_lines if name == "filter_text" else glossary.merge
            lines = how(_lines(known, name), _lines(state, name), ("file_name",))
            text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "line"))), lambda x: x["line"]), "\n")
            state = state.drop(name).join(lines.groupBy("file_name").agg(text.alias(name)), "file_name", "left")
    joined = state.join(files, "file_name", "left")
    fields = [F.coalesce(name, F.lit("")).alias(name) for name in SETTINGS]
    return joined.select("file_name", with_values(F.col("value"), F.struct(*fields)).alias("value"))


def imported(session: DataFrame, files: DataFrame) -> DataFrame:
    """A session's rows with the texts and patterns of their settings files (``read_settings``); those without one stay."""
    theirs = files.select("file_name", F.struct(*SETTINGS).alias("_s"))
    joined = session.join(theirs, "file_name", "left")
    known = {mine: F.coalesce(F.col(f"_s.{name}"), F.col(mine)) for name, mine in SESSION_NAMES.items()}
    patterns = {p: F.coalesce(F.col(f"_s.{p}"), F.col(p) if p in session.columns else F.lit(SETTINGS[p])) for p in PATTERNS}
    return joined.withColumns(known | patterns).drop("_s")


def saved_cache(files: DataFrame, session: DataFrame) -> DataFrame:
    """(file_name, value): session files of ``read_cache`` rows, migrated fields written back, unknown keys kept."""
    fields = [*CACHE_TEXT, *CACHE_NUMBER, "original_cache_limit", *CACHE_FLAG, "url_related_links", "url_history", "work_history"]
    joined = session.select("file_name", *fields).join(files, "file_name", "left")
    return joined.select("file_name", with_values(F.col("value"), F.struct(*fields)).alias("value"))
