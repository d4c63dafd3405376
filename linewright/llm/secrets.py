"""Secret scan with linking of multipart credentials, in built-in functions only.

Strong kinds (assign, access, hex) are always reported. Weak kinds (an identifier, a key,
an endpoint) are candidates: they are reported only where complementary parts co-occur.
Parts of a document that lie at most ``REACH`` code points apart form a scope, an
interval; parts are joined to the scope interval they lie in (by document and by the
``CELL``-wide cells that the interval touches, so the join is an equi-join with a
range check, and each part meets one scope). In a scope that has a secret (assign,
hex or key) besides an identifier (access or ident) or an endpoint, weak parts are kept,
but for those that overlap a strong one.

Texts are scanned once; their spans go to a table of the shared folder with a number for
each row, by which parts are linked. Only rows whose spans could complement each other
are shuffled. Work grows with the length of a text times the number of its spans over
the size of a fold, as running sums and masks are built in folds.

Cases: a null or empty text has no spans. Repeated rows are reported alike. A null doc_id
stays null. An empty table gives no rows. Columns other than doc_id and text are ignored
by the report; ``redact`` returns the columns it was given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.functions.rx import FOLD, let, running
from linewright.llm import tables

REACH = 200
CELL = 4096
MASK = "[SECRET]"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _words(*words: str) -> str:
    return "|".join(_any_case(w) for w in words)


_GIVEN = "[\"']?\\x20*[:=]\\x20*[\"']?"
#: Kind, pattern, the group that must be long enough and its least length; in order of rank.
STRONG = (
    ("assign", f"({_words('password', 'passwd', 'secret', 'token')}|{_any_case('api')}_?{_any_case('key')}){_GIVEN}([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)
WEAK = (
    ("ident", f"({_words('username', 'user', 'login', 'account', 'client_id', 'clientid', 'access_key_id')}){_GIVEN}([A-Za-z0-9@+/_.=-]+)", 2, 3),
    ("key", f"({_words('private_key', 'access_key', 'auth', 'credential', 'pwd', 'pass', 'bearer')}){_GIVEN}([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("endpoint", "[a-z][a-z0-9+.-]*://[A-Za-z0-9@:%_+.~#?&/=-]+", 0, 8),
)
KINDS = STRONG + WEAK
SECRETS, IDENTIFIERS, ENDPOINTS = ("assign", "hex", "key"), ("access", "ident"), ("endpoint",)
#: Cheap tests that hold wherever the pattern has a match that is long enough.
_TESTS = {"hex": "[0-9a-f]{24}", "access": "AKIA[A-Z0-9]{16}"}
_SPANS = "array<struct<s:int,e:int,ok:boolean>>"


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Start and end, in code points, of the leftmost non-overlapping matches, with whether the group is long enough.

    The text between matches gives the gaps; running sums of gaps and matches give the places.
    """
    # A run of a class is matched whole, so the shorter runs between can be left out from the start.
    used = {"[0-9a-f]+": "[0-9a-f]{24,}", "AKIA[A-Z0-9]+": "AKIA[A-Z0-9]{16,}"}.get(pattern, pattern)

    def places(found: Column) -> Column:
        before = running(F.transform(found, lambda x: x["gap"] + x["len"]), lambda a, b: a + b)
        return F.zip_with(found, before, lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["len"]).alias("e"), x["ok"].alias("ok")))

    gaps = F.transform(F.split(text, used, -1), lambda p: F.length(p))
    hits = F.regexp_extract_all(text, F.lit(used), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(used), F.lit(group))
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), held.alias("held")),
        lambda z: F.struct(z["gap"].alias("gap"), F.length(z["hit"]).alias("len"), (F.length(z["held"]) >= least).alias("ok")),
    )
    found = F.filter(rows, lambda x: x["len"].isNotNull())
    none = F.array().cast(_SPANS)
    return F.when(text.rlike(_TESTS.get(_name(pattern), used)), let(found, places)).otherwise(none)


def _name(pattern: str) -> str:
    return next((k for k, p, _, _ in KINDS if p == pattern), "")


def _with_rank(rank: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"))


def _ranked(kinds: tuple, text: Column) -> Column:
    """The long-enough spans of some kinds as one array of (s, rank, e)."""
    arrays = []
    for kind, pattern, group, least in kinds:
        rank = [k for k, *_ in KINDS].index(kind)
        kept = F.filter(spans(text, pattern, group, least), lambda x: x["ok"])
        arrays.append(F.transform(kept, _with_rank(rank)))
    return F.flatten(F.array(*arrays))


def _is(rank: Column, names: tuple[str, ...]) -> Column:
    return rank.isin(*[i for i, (k, *_) in enumerate(KINDS) if k in names])


def _role(names: tuple[str, ...]) -> Column:
    return _is(F.col("rank"), names)


def _apart(parts: DataFrame) -> DataFrame:
    """The parts without weak ones that overlap a strong one."""
    order = Window.partitionBy("key").orderBy("s", "rank", "e")
    strong = F.col("rank") < len(STRONG)
    before = F.max(F.when(strong, F.col("e"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("key").orderBy(F.desc("s"), F.desc("rank"), F.desc("e"))  # a frame up to the last row would be summed anew for every row
    after = F.min(F.when(strong, F.col("s"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    met = F.coalesce(before > F.col("s"), F.lit(False)) | F.coalesce(after < F.col("e"), F.lit(False))
    return parts.withColumn("_met", met).filter(strong | ~F.col("_met")).drop("_met")


def link(parts: DataFrame) -> DataFrame:
    """The weak parts (key, s, rank, e) that complementary parts of their scope confirm; key stands for one text."""
    parts = _apart(parts)
    order = Window.partitionBy("key").orderBy("s", "rank", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = parts.withColumn("_new", F.when(F.col("s") - reach <= REACH, 0).otherwise(1))
    opened = opened.withColumn("_scope", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    scopes = opened.groupBy("key", "_scope").agg(
        F.min("s").alias("from"), F.max("e").alias("to"),
        F.max(_role(SECRETS)).alias("_secret"), F.max(_role(IDENTIFIERS) | _role(ENDPOINTS)).alias("_other"),
    )
    whole = scopes.filter("_secret AND _other").select("key", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / CELL), F.floor(F.col("to") / CELL))).alias("cell"))
    placed = parts.filter(F.col("rank") >= len(STRONG)).withColumn("cell", F.floor(F.col("s") / CELL))
    near = (placed["key"] == whole["key"]) & (placed["cell"] == whole["cell"]) & (placed["s"] >= whole["from"]) & (placed["s"] < whole["to"])
    return placed.join(whole, near).select(placed["key"], "s", "rank", "e")


def _found(docs: DataFrame, carried: list[Column]) -> DataFrame:
    """The carried columns with _strong and _weak, arrays of (s, rank, e)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<s:int,rank:int,e:int>>")
    weak = F.when(text.rlike("|".join(p for _, p, _, _ in WEAK)), _ranked(WEAK, text)).otherwise(none)
    scanned = docs.select(F.monotonically_increasing_id().alias("_key"), F.array_sort(_ranked(STRONG, text)).alias("_strong"), weak.alias("_weak"), *carried)
    scanned = tables.cut(docs.sparkSession, scanned, "spans")

    has = lambda names: F.exists("_strong", lambda x: _is(x["rank"], names)) | F.exists("_weak", lambda x: _is(x["rank"], names))
    open_ = (F.size("_weak") > 0) & has(SECRETS) & has(IDENTIFIERS + ENDPOINTS)
    asked = scanned.filter(open_)
    parts = asked.select(F.col("_key").alias("key"), F.explode(F.concat("_strong", "_weak")).alias("p")).select("key", "p.s", "p.rank", "p.e")
    linked = link(parts).groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("s", "rank", "e")).alias("_linked"))
    asked = asked.drop("_weak").join(linked, "_key", "left").withColumn("_weak", F.coalesce("_linked", none)).drop("_linked")
    return scanned.filter(~open_).withColumn("_weak", none).unionByName(asked).drop("_key")


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the strong kinds, the digest of their spans, and all spans."""
    found = _found(docs, [F.col("doc_id")])
    count = lambda rank: F.size(F.filter("_strong", lambda x: x["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(STRONG)),
        F.sha2(_written(F.col("_strong")).cast("binary"), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("_strong", "_weak"))).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by MASK; n_chars, where there is one, follows the text."""
    found = _found(docs, [F.struct(*tables.columns(docs)).alias("_row")])

    text = F.col("_row.text")

    def rebuilt(found: Column) -> Column:
        """The text between the spans and a mask for each run of overlapping ones, in blocks of FOLD spans."""
        reach = running(F.transform(found, lambda x: x["e"]), F.greatest)
        placed = F.zip_with(found, reach, lambda x, r: F.struct(x["s"].alias("s"), x["e"].alias("e"), r.alias("r")))

        def block(own: Column) -> Column:
            def masked(stretch: Column) -> Column:
                before = lambda x: F.substring(stretch, x["r"] - own[0]["r"] + 1, x["s"] - x["r"])
                return F.array_join(F.transform(own, lambda x: F.when(x["s"] >= x["r"], F.concat(before(x), F.lit(MASK))).otherwise("")), "")

            return let(F.substring(text, own[0]["r"] + 1, F.element_at(own, -1)["s"] - own[0]["r"]), masked)

        def joined(m: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(m), F.lit(FOLD))
            blocks = F.transform(starts, lambda at: let(F.slice(m, at, F.lit(FOLD)), block))
            last = F.greatest(F.element_at(m, -1)["r"], F.element_at(m, -1)["e"])
            return F.concat(F.array_join(blocks, ""), F.substring(text, last + 1, F.length(text)))

        return let(placed, joined)

    some = F.size(F.col("_strong")) + F.size(F.col("_weak")) > 0
    clean = found.withColumn("_text", F.when(some, let(F.array_sort(F.concat("_strong", "_weak")), rebuilt)).otherwise(text))
    length = {"n_chars": F.when(some, F.length("_text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return clean.select(*(F.col("_text").alias(c) if c == "text" else length[c].alias(c) if c in length else F.col("_row").getField(c).alias(c) for c in docs.columns))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(tables.read(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_parts() -> str:
    return "\n  UNION ALL ".join(
        f"SELECT doc_id, {rank} AS rank, {_quoted(kind)} AS kind, {least} AS least, regexp_extract_all(t, {_quoted(p)}) AS hits, "
        f"regexp_extract_all(t, {_quoted(p)}, {group}) AS held, string_split_regex(t, {_quoted(p)}) AS gaps FROM d"
        for rank, (kind, p, group, least) in enumerate(KINDS)
    )


def _sql_ranks(names: tuple[str, ...]) -> str:
    return "kind IN (" + ", ".join(map(_quoted, names)) + ")"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({_sql_parts()}),
h AS (SELECT doc_id, rank, kind, least, i, length(hits[i]) AS n, length(held[i]) AS m, length(gaps[i]) AS g FROM k, unnest(range(1, len(hits) + 1)) AS r(i)),
p AS (SELECT doc_id, rank, kind, m >= least AS ok, n,
  sum(g + n) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM h),
a AS (SELECT doc_id, rank, kind, (e - n)::BIGINT AS s, e::BIGINT AS e FROM p WHERE ok),
c AS (SELECT * FROM a WHERE rank < {len(STRONG)} OR NOT EXISTS (
  SELECT 1 FROM a AS x WHERE x.doc_id = a.doc_id AND x.rank < {len(STRONG)} AND a.s < x.e AND x.s < a.e)),
o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, rank, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
n AS (SELECT *, sum(CASE WHEN s - reach <= {REACH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, rank, e) AS scope FROM o),
z AS (SELECT doc_id, scope FROM n GROUP BY doc_id, scope HAVING bool_or({_sql_ranks(SECRETS)}) AND bool_or({_sql_ranks(IDENTIFIERS + ENDPOINTS)})),
w AS (SELECT n.doc_id, rank, kind, s, e FROM n SEMI JOIN z ON n.doc_id = z.doc_id AND n.scope = z.scope WHERE rank >= {len(STRONG)}),
b AS (SELECT doc_id, rank, kind, s, e FROM a WHERE rank < {len(STRONG)}),
x AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS base FROM b GROUP BY doc_id),
y AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM (SELECT * FROM b UNION ALL SELECT * FROM w) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN y ON d.doc_id = y.doc_id
"""
