"""Named queries over the driver's tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as fx
from quern.operators import forms, relational, reversi
from quern.sources import boards, listings, posts

#: Query strings, bands and offsets of the queries below.
TYPED, ITEMS = "re", 8
BANDS = (("debt", -1000.0, 1000.0), ("low", 0.0, 2500.0), ("middle", 2000.0, 4000.0), ("high", 6000.0, 4000.0))
OFFSETS = ((-500.0, "a"), (0.0, "b"), (1000.0, "c"), (4000.0, "d"), (4000.0, "e"), (9000.0, "f"))
SECTIONS = (("intro", 0.0), ("work", 3000.0), ("about", 1500.0))
RETURN_WEIGHTS = (("R", "F", 3), ("A", "F", 2), ("N", "F", 1), ("N", "O", -2))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: place, id, title, content and tags."""
    d = _table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"))


def _values(spark: SparkSession, rows: tuple, names: str) -> DataFrame:
    text = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}D" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({names})")


def read_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.word_count(fx.strip_tags(F.col("text"))).cast("long")
    return _table(spark, sf_dir, "documents").select("doc_id", words.alias("words")).select("doc_id", "words", fx.read_minutes(F.col("words")).alias("read_min"))


def page_read_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.word_count(fx.strip_tags(F.col("html"))).cast("long")
    return _table(spark, sf_dir, "pages").select("page_id", words.alias("words")).select("page_id", "words", fx.read_minutes(F.col("words")).alias("read_min"))


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.html_escape(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(e).alias("escaped_md5"), F.length(e).cast("long").alias("escaped_chars"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.first_match(_posts(spark, sf_dir), F.col("id") == 42, "pos").select("id", F.length("content").cast("long").alias("chars"))


def hash_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _posts(spark, sf_dir)
    n = F.col("e.event_id")
    odd = F.when(n % 7 == 0, F.lit("#top")).when(n % 11 == 0, F.concat(F.lit("#post-"), n, F.lit("x"))).otherwise(F.concat(F.lit("#post-"), n))
    hashes = _table(spark, sf_dir, "events").alias("e").select(odd.alias("hash")).distinct()
    return relational.route(posts, hashes)


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.tag_counts(_posts(spark, sf_dir), "pos")


def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.with_tag(_posts(spark, sf_dir), "fr").select("id")


def tag_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No tag selects all; counted by tag, so that the result says that none is missing."""
    return relational.with_tag(_posts(spark, sf_dir), None).groupBy(F.get("tags", F.lit(0)).alias("first_tag")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_type"), " ").alias("classes"))
    return relational.with_class(parts, ".promo").select("p_partkey")


def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.head_flag(_posts(spark, sf_dir), "pos").select("id", F.slice("tags", 1, 2).getItem(0).alias("first_tag"), "is_featured")


def post_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.count_label(_posts(spark, sf_dir))


def blank_to_nbsp(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 5 == 0, F.lit(" ")).when(F.col("c_custkey") % 5 == 1, F.lit("")).when(F.col("c_custkey") % 5 == 2, F.lit("  ")).otherwise(F.nullif("c_mktsegment", F.lit("BUILDING")))
    return c.select("c_custkey", fx.blank_cell(raw).alias("cell"))


def struct_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_id", "p.*")


def weighted_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = _values(spark, RETURN_WEIGHTS, "l_returnflag, l_linestatus, w")
    lines = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    mine, theirs = F.col("l_quantity") >= 25, F.col("l_quantity") < 25
    out = relational.weighted_difference(lines, weights, ["l_suppkey"], ["l_returnflag", "l_linestatus"], mine, theirs)
    return out.select("l_suppkey", F.col("score").cast("long").alias("score"))


def argmax_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("thousands"))
    return relational.best_of(orders, ["o_custkey"], "thousands", "o_orderkey", above=-10)


def typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.typeahead(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), TYPED, "p_name", "p_partkey", ITEMS)


def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", fx.highlight(F.col("p_name"), TYPED).alias("html"))


def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = _values(spark, BANDS, "name, top, height")
    return relational.interval_lookup(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), bands, "c_acctbal")


def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.asof_lookup(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), OFFSETS, "c_acctbal")


def last_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.last_section(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), SECTIONS, "c_acctbal", 100.0)


def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("page#"), F.col("c_nationkey").cast("string")).alias("href"))
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n_key"), "n_name")
    return relational.lookup(links, nations, "href", "n_key").select("c_custkey", "n_name")


def form_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    form = c.select(
        "c_custkey",
        F.when(k % 4 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.concat(F.lit("user"), k.cast("string"), F.when(k % 3 == 0, F.lit(" at x")).otherwise(F.lit("@example.com"))).alias("email"),
        F.when(k % 5 == 0, F.lit("12a")).otherwise(k.cast("string")).alias("zipcode"),
        F.when(k % 6 == 0, F.lit("2020-02-31")).otherwise(F.lit("2020-02-28")).alias("birthday"),
        F.lit("secret").alias("password"),
        F.when(k % 7 == 0, F.lit("other")).otherwise(F.lit("secret")).alias("confirm"),
        F.when(k % 10 != 9, k % 10 != 3).alias("accepted"),
    )
    rules = {
        "name": forms.required(F.col("name")),
        "email": forms.is_email(F.col("email")),
        "zipcode": forms.is_number(F.col("zipcode")),
        "birthday": forms.is_date(F.col("birthday")),
        "password": forms.same(F.col("password"), F.col("confirm")),
        "terms": forms.accepted(F.col("accepted")),
    }
    return forms.check(form, rules).select("c_custkey", "errors", "valid")


#: Suppliers of a listing document.
LISTED = 50


def _listing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as listing documents of bounded size, some of them damaged or empty."""
    s = _table(spark, sf_dir, "supplier")
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    key = F.col("s_suppkey").cast("string")
    location = tag("Location", F.concat(*(tag(n, F.when(F.lit(n == "Zip"), F.lpad(key, 5, "0")).otherwise(F.lit(" "))) for n in listings.LOCATION)))
    details = tag("ListingDetails", F.concat(tag("Status", F.lit("Active")), tag("Price", key), F.lit("<ListingUrl/>"), tag("Image", fx.html_escape(F.col("s_name")))))
    one = s.select("s_nationkey", F.expr(f"s_suppkey div {LISTED}").alias("part"), F.struct("s_suppkey", tag("Listing", F.concat(location, details)).alias("x")).alias("l"))
    nation = F.col("s_nationkey") % 5
    body = F.when(nation == 2, F.lit("")).otherwise(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: l["x"]), "\n"))
    end = F.when(nation == 3, F.lit("</Listings>junk")).when(nation == 4, F.lit("")).otherwise(F.lit("</Listings>"))
    return one.groupBy("s_nationkey", "part").agg(body.alias("b")).select("s_nationkey", "part", F.concat(F.lit("<Listings>"), "b", end).alias("xml"))


def xml_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.parse(_listing_documents(spark, sf_dir)).select("s_nationkey", "part", "status", F.coalesce(F.size("listings"), F.lit(0)).cast("long").alias("n"))


def xml_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = listings.row_html(listings.flatten(listings.parse(_listing_documents(spark, sf_dir))))
    return out.select("s_nationkey", "part", F.col("pos").cast("long").alias("pos"), *listings.LOCATION, *listings.DETAILS, "html")


def xml_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = listings.table(listings.flatten(listings.parse(_listing_documents(spark, sf_dir))), ["s_nationkey", "part"])
    return t.select("s_nationkey", "part", F.md5("table").alias("table_md5"), F.length("table").cast("long").alias("chars"))


def _told_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON documents of posts, some of a bounded number each, read back."""
    d = _table(spark, sf_dir, "documents")
    title = F.concat(F.lit("<"), F.col("source"), F.lit("> & \""), F.col("doc_id"), F.lit('"'))
    tags = F.when(F.col("doc_id") % 7 != 0, F.array("lang", "source", "lang"))
    post = F.struct(
        F.col("doc_id").alias("id"), F.lit("May 1, 2020").alias("date"), title.alias("title"), F.left("text", F.lit(40)).alias("summary"), F.col("text").alias("content"), tags.alias("tags")
    )
    gathered = F.when(F.col("chunk") % 9 == 4, F.lit(None)).otherwise(F.array_sort(F.collect_list("p"), lambda a, b: a["id"].cast("int") - b["id"].cast("int")))
    docs = d.select(F.expr("doc_id div 20").alias("chunk"), post.alias("p")).groupBy("chunk").agg(gathered.alias("posts"))
    return posts.parse(docs.select("chunk", F.to_json(F.struct("posts")).alias("json")))


def json_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told_posts(spark, sf_dir).select("chunk", "pos", "id", "date", "title", F.md5("content").alias("content_md5"), F.size(F.coalesce("tags", F.array())).cast("long").alias("n_tags"))


def post_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.cards(_told_posts(spark, sf_dir)).select("id", "title", "summary", "date", "read_min", F.array_join("tags", ",").alias("tags"))


def grid_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.cards(_told_posts(spark, sf_dir), 2).select("id", "title", "summary", "date", "read_min", F.array_join("tags", ",").alias("tags"))


def card_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.card_html(_told_posts(spark, sf_dir), 2).select("id", "html")


def tags_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told_posts(spark, sf_dir).select("id", fx.tags_html(F.col("tags")).alias("html"))


def item_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region as carousel items, joined as they come; a handler that numbers them takes the place of the default."""
    n = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    items = F.transform("n", lambda x: F.struct(F.concat(F.lit("<li>"), x["n_name"], F.lit("</li>")).alias("item")))
    docs = n.select("n_regionkey", F.to_json(F.struct(items.alias("owl"))).alias("json"))
    counted = posts.items_html(docs, handler=lambda x: F.concat(F.lit("<ol>"), F.size(x).cast("string"), F.lit("</ol>"))).select("n_regionkey", F.col("html").alias("counted"))
    return posts.items_html(docs).join(counted, "n_regionkey")


def list_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch that a page takes for all documents, and for those of a language that there is none of."""
    p = _posts(spark, sf_dir)
    return relational.state(p).withColumn("tag", F.lit("all")).unionByName(relational.state(relational.with_tag(p, "none such")).withColumn("tag", F.lit("none such")))


def hash_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    n = F.col("event_id")
    hash_ = F.when(n % 5 == 0, F.lit("#post")).when(n % 5 == 1, F.concat(F.lit("#post-"), n)).when(n % 5 == 2, F.concat(F.lit("x#post-"), n)).when(n % 5 == 3, F.lit("#post-x"))
    return e.select("event_id", fx.is_post_hash(hash_).alias("is_post"))


def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return relational.merge_unique(d.select(F.col("lang").alias("tag")), d.select(F.col("source").alias("tag")))


def typeahead_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that is a function of the query: parts whose names hold it, of even size only."""
    part = _table(spark, sf_dir, "part")
    return relational.typeahead(lambda q: part.where("p_size % 2 = 0").select("p_partkey", "p_name"), TYPED, "p_name", "p_partkey", ITEMS)


def any_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") > 1, F.col("l_linestatus")).alias("before"), F.when(F.col("l_returnflag") != "A", F.col("l_linestatus")).alias("after"))
    return relational.changed(lines, ["l_orderkey"], "before", "after")


def cell_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 8).alias("i"), (F.col("p_partkey") % 8).cast("int").alias("j"))
    p = p.withColumn("code", fx.encode_cell(F.col("i"), F.col("j")))
    i, j = fx.decode_cell(F.col("code"))
    return p.select("p_partkey", "code", i.alias("i"), j.alias("j"))


def other_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    player = F.when(key % 3 == 0, "X").when(key % 3 == 1, "O").otherwise(F.col("c_mktsegment"))
    return _table(spark, sf_dir, "customer").select("c_custkey", fx.opposite(player).alias("opponent"))


def _board_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards made from customers: the opening position, other cells by a rule."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("board_id"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    start = F.when(F.col("k").isin(27, 36), "O").when(F.col("k").isin(28, 35), "X")
    noise = F.pmod(F.col("board_id") * 31 + F.col("k") * 17, F.lit(7))
    other = F.when(noise == 0, "X").when(noise == 1, "O").otherwise("*")
    player = F.when(F.col("board_id") % 2 == 0, "X").otherwise("O")
    return c.select("board_id", player.alias("player"), F.expr("k div 8").cast("int").alias("i"), (F.col("k") % 8).alias("j"), F.coalesce(start, other).alias("cell"))


def board_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.board_text(_board_cells(spark, sf_dir))


def board_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards as texts with a head, read back."""
    text = boards.board_text(_board_cells(spark, sf_dir)).select("board_id", F.concat(F.lit(" 2 X\n3 "), "text", F.lit("\n")).alias("text"))
    return boards.parse_boards(text)


def board_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversi.scored(_board_cells(spark, sf_dir)).select("board_id", "cell", F.size("flipped").cast("long").alias("flipped"), F.col("score").cast("long").alias("score"))


def board_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversi.greedy(_board_cells(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        read_time, page_read_time, html_escape, point_lookup, hash_route, tag_counts, tag_filter, tag_filter_all, class_filter, head_tail, post_count,
        blank_to_nbsp, struct_flatten, weighted_diff, argmax_tie, typeahead, highlight, interval_lookup, asof_lookup, last_section, section_lookup,
        form_validate, xml_status, xml_listings, xml_table, json_posts, post_cards, grid_cards, card_html, tags_html, item_html, list_state, hash_prefix,
        tag_union, typeahead_source, any_changed, cell_codes, other_player, board_texts, board_cells, board_moves, board_greedy,
    )
}


def _rows(rows: tuple) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _read_time(table: str, key: str, text: str) -> str:
    return rf"""
WITH d AS (
  SELECT {key}, len(regexp_split_to_array(regexp_replace(regexp_replace(coalesce({text}, ''), '<[^>]+>', ' ', 'g'),
         '^\s+|\s+$', '', 'g'), '\s+'))::BIGINT AS words FROM {table})
SELECT {key}, words, greatest(1, floor(words / 220.0 + 0.5))::BIGINT AS read_min FROM d
"""


_ESCAPED = "replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"



def _escape(c: str) -> str:
    return f"replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


_TOLD = """
p AS (
  SELECT doc_id // 20 AS chunk, (row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1)::BIGINT AS pos, doc_id AS id, 'May 1, 2020' AS date,
         '<' || source || '> & "' || doc_id || '"' AS title, left(text, 40) AS summary, text AS content,
         CASE WHEN doc_id % 7 <> 0 THEN [lang, source, lang] ELSE [] END AS tags
  FROM documents WHERE (doc_id // 20) % 9 <> 4
)"""


def _cards(tags: str) -> str:
    return rf"""
WITH {_TOLD}, d AS (
  SELECT *, len(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(content, ''), '<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+')) AS words FROM p
)
SELECT id, title, summary, date, greatest(1, floor(words / 220.0 + 0.5))::BIGINT AS read_min, coalesce(array_to_string({tags}, ','), '') AS tags FROM d
"""


_TAG = lambda t: f"""coalesce(array_to_string(list_transform({t}, lambda x: '<span class="tag">' || {_escape('x')} || '</span>'), ''), '')"""

_LISTED = f"""
s AS (
  SELECT *, s_suppkey // {LISTED} AS part, s_suppkey::VARCHAR AS key, lpad(s_suppkey::VARCHAR, 5, '0') AS zip,
         row_number() OVER (PARTITION BY s_nationkey, s_suppkey // {LISTED} ORDER BY s_suppkey) - 1 AS pos
  FROM supplier
), h AS (
  SELECT *, '<tr>' || repeat('<td>&nbsp;</td>', 3) || '<td>' || zip || '</td>' || repeat('<td>&nbsp;</td>', 2) || '<td>Active</td><td>' || key
            || '</td><td>&nbsp;</td><td><img src="' || {_escape('s_name')} || '" alt="' || {_escape('s_name')} || '"></td></tr>' AS html
  FROM s WHERE s_nationkey % 5 < 2
)"""

_BOARDS = """
cells AS (
  SELECT c_custkey AS board_id, k, CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE 'O' END AS player, CASE WHEN c_custkey % 2 = 0 THEN 'O' ELSE 'X' END AS opp,
         CASE WHEN k IN (27, 36) THEN 'O' WHEN k IN (28, 35) THEN 'X' WHEN (c_custkey * 31 + k * 17) % 7 = 0 THEN 'X'
              WHEN (c_custkey * 31 + k * 17) % 7 = 1 THEN 'O' ELSE '*' END AS cell
  FROM customer, (SELECT unnest(range(64)) AS k)
), b AS (SELECT board_id, player, opp, string_agg(cell, '' ORDER BY k) AS b FROM cells GROUP BY ALL)"""

_MOVES = f"""
WITH {_BOARDS}, w(k, w) AS (VALUES {", ".join(f"({8 * i + j}, {x})" for i, row in enumerate(reversi.WEIGHTS) for j, x in enumerate(row))}),
standing AS (SELECT board_id, sum(CASE cell WHEN player THEN w WHEN opp THEN -w ELSE 0 END) AS standing FROM cells JOIN w USING (k) GROUP BY board_id),
way AS (SELECT * FROM (SELECT unnest([-1, 0, 1]) AS di), (SELECT unnest([-1, 0, 1]) AS dj) WHERE di <> 0 OR dj <> 0),
step AS (SELECT unnest(range(1, 8)) AS s),
ray AS (
  SELECT board_id, k, di, dj, player, opp, s, (k // 8 + s * di) * 8 + k % 8 + s * dj AS spot
  FROM cells, way, step WHERE cell = '*' AND k // 8 + s * di BETWEEN 0 AND 7 AND k % 8 + s * dj BETWEEN 0 AND 7
), seen AS (
  SELECT r.board_id, r.k, di, dj, r.player, r.opp, s, spot, c.cell AS cell,
         min(s) FILTER (c.cell <> r.opp) OVER (PARTITION BY r.board_id, r.k, di, dj) AS stop,
         max(CASE WHEN c.cell = r.player THEN s END) OVER (PARTITION BY r.board_id, r.k, di, dj) IS NOT NULL AS any_own
  FROM ray r JOIN cells c ON r.board_id = c.board_id AND r.spot = c.k
), closed AS (
  SELECT DISTINCT board_id, k, di, dj, stop FROM seen WHERE s = stop AND cell = player
), turned AS (
  SELECT seen.board_id, seen.k, seen.player, spot FROM seen JOIN closed USING (board_id, k, di, dj) WHERE s < closed.stop
), m AS (
  SELECT t.board_id, t.k, t.player, (t.k // 8) * 10 + t.k % 8 AS cell, count(*) AS flipped, list(spot) AS ats, any_value(standing) + sum(w) AS score
  FROM turned t JOIN w ON spot = w.k JOIN standing s ON t.board_id = s.board_id GROUP BY t.board_id, t.k, t.player
)"""

ORACLES: dict[str, str] = {
    "read_time": _read_time("documents", "doc_id", "text"),
    "page_read_time": _read_time("pages", "page_id", "html"),
    "html_escape": f"SELECT page_id, md5({_ESCAPED}) AS escaped_md5, length({_ESCAPED})::BIGINT AS escaped_chars FROM pages",
    "point_lookup": "SELECT doc_id AS id, length(text)::BIGINT AS chars FROM documents WHERE doc_id = 42 ORDER BY doc_id LIMIT 1",
    "hash_route": r"""
WITH h AS (
  SELECT DISTINCT CASE WHEN event_id % 7 = 0 THEN '#top' WHEN event_id % 11 = 0 THEN '#post-' || event_id || 'x' ELSE '#post-' || event_id END AS hash FROM events
), x AS (SELECT hash, TRY_CAST(nullif(regexp_extract(hash, '^#post-(\d+)$', 1), '') AS BIGINT) AS post_id FROM h),
p AS (SELECT doc_id, min(doc_id) AS post_pos FROM documents GROUP BY doc_id)
SELECT hash, post_id, post_pos, post_pos IS NULL AS is_listing FROM x LEFT JOIN p ON post_id = doc_id
""",
    "tag_counts": """
WITH t AS (SELECT doc_id, unnest([lang, source]) AS tag, unnest([0, 1]) AS tag_pos FROM documents),
n AS (SELECT tag, count(*) AS n, min((doc_id, tag_pos)) AS first_seen FROM t GROUP BY tag)
SELECT tag, n, row_number() OVER (ORDER BY n DESC, first_seen) AS rank FROM n
""",
    "tag_filter": "SELECT doc_id AS id FROM documents WHERE list_contains([lang, source], 'fr')",
    "tag_filter_all": "SELECT lang AS first_tag, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY lang",
    "class_filter": "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_type), ' '), 'promo')",
    "head_tail": "SELECT doc_id AS id, lang AS first_tag, doc_id = (SELECT min(doc_id) FROM documents) AS is_featured FROM documents",
    "post_count": "SELECT count(*) AS n, count(*) || ' post' || CASE WHEN count(*) <> 1 THEN 's' ELSE '' END AS label FROM documents",
    "blank_to_nbsp": """
WITH c AS (
  SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE nullif(c_mktsegment, 'BUILDING') END AS raw FROM customer)
SELECT c_custkey, CASE WHEN raw IS NULL OR raw IN ('', ' ') THEN '&nbsp;' ELSE raw END AS cell FROM c
""",
    "struct_flatten": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "weighted_diff": f"""
WITH w(f, s, w) AS (VALUES {_rows(RETURN_WEIGHTS)})
SELECT l_suppkey, (coalesce(sum(w) FILTER (l_quantity >= 25), 0) - coalesce(sum(w) FILTER (l_quantity < 25), 0))::BIGINT AS score
FROM lineitem JOIN w ON l_returnflag = f AND l_linestatus = s GROUP BY l_suppkey
""",
    "argmax_tie": """
WITH o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice / 1000)::BIGINT AS thousands FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY thousands DESC, o_orderkey) AS n FROM o WHERE thousands > -10)
SELECT o_custkey, thousands, o_orderkey FROM r WHERE n = 1
""",
    "typeahead": f"""
WITH m AS (
  SELECT p_partkey, p_name, CASE WHEN instr(lower(p_name), '{TYPED}') = 1 THEN 0 WHEN instr(p_name, '{TYPED}') > 0 THEN 1 ELSE 2 END AS c
  FROM part WHERE instr(lower(p_name), '{TYPED}') > 0
), r AS (SELECT *, row_number() OVER (ORDER BY c, p_partkey) AS rank FROM m)
SELECT p_partkey, p_name, regexp_replace(p_name, '({TYPED})', '<strong>\\1</strong>', 'gi') AS html, rank FROM r WHERE rank <= {ITEMS}
""",
    "highlight": f"SELECT p_partkey, regexp_replace(p_name, '({TYPED})', '<strong>\\1</strong>', 'gi') AS html FROM part",
    "interval_lookup": f"""
WITH b(name, top, height) AS (VALUES {_rows(BANDS)})
SELECT c_custkey, c_acctbal, name AS band FROM customer JOIN b ON c_acctbal >= top AND c_acctbal < top + height
""",
    "asof_lookup": f"""
WITH o AS (SELECT *, row_number() OVER () AS n FROM (VALUES {_rows(OFFSETS)}) AS t(o, t))
SELECT c_custkey, c_acctbal, (SELECT arg_max(t, (o, n)) FROM o WHERE o <= c_acctbal) AS target FROM customer
""",
    "last_section": f"""
WITH s AS (SELECT *, row_number() OVER () AS n FROM (VALUES {_rows(SECTIONS)}) AS t(name, p))
SELECT c_custkey, c_acctbal, (SELECT arg_max(name, n) FROM s WHERE p - 100.0 < c_acctbal) AS section FROM customer
""",
    "section_lookup": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "form_validate": """
WITH k AS (SELECT c_custkey AS k, c_name FROM customer),
e AS (
  SELECT k, concat_ws(',', CASE WHEN k % 4 = 0 OR coalesce(c_name, '') = '' THEN 'name' END, CASE WHEN k % 3 = 0 THEN 'email' END,
    CASE WHEN k % 5 = 0 THEN 'zipcode' END, CASE WHEN k % 6 = 0 THEN 'birthday' END, CASE WHEN k % 7 = 0 THEN 'password' END,
    CASE WHEN k % 10 IN (3, 9) THEN 'terms' END) AS errors FROM k)
SELECT k AS c_custkey, errors, errors = '' AS valid FROM e
""",
    "xml_status": f"""
SELECT s_nationkey, s_suppkey // {LISTED} AS part, CASE WHEN s_nationkey % 5 = 2 THEN 'no listings' WHEN s_nationkey % 5 > 2 THEN 'invalid' ELSE 'ok' END AS status,
       count(*) FILTER (s_nationkey % 5 < 2) AS n
FROM supplier GROUP BY s_nationkey, s_suppkey // {LISTED}
""",
    "xml_listings": f"""
WITH {_LISTED}
SELECT s_nationkey, part, pos::BIGINT AS pos, ' ' AS StreetAddress, ' ' AS City, ' ' AS State, zip AS Zip, ' ' AS Lat, ' ' AS Long, 'Active' AS Status, key AS Price,
       '' AS ListingUrl, s_name AS Image, html
FROM h
""",
    "xml_table": f"""
WITH {_LISTED}, t AS (SELECT s_nationkey, part, '{listings.HEADER}' || string_agg(html, '' ORDER BY pos) || '</table>' AS t FROM h GROUP BY ALL)
SELECT s_nationkey, part, md5(t) AS table_md5, length(t)::BIGINT AS chars FROM t
""",
    "json_posts": f"WITH {_TOLD} SELECT chunk, pos, id, date, title, md5(content) AS content_md5, len(tags)::BIGINT AS n_tags FROM p",
    "post_cards": _cards("tags"),
    "grid_cards": _cards("tags[1:2]"),
    "card_html": rf"""
WITH {_TOLD}, d AS (
  SELECT *, len(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(content, ''), '<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+')) AS words FROM p
)
SELECT id, '<article data-id="' || id || '"><h2>' || {_escape('title')} || '</h2><p>' || {_escape('summary')} || '</p><time>' || date || '</time><small>'
           || greatest(1, floor(words / 220.0 + 0.5))::BIGINT || ' min</small>' || {_TAG('tags[1:2]')} || '</article>' AS html
FROM d
""",
    "tags_html": f"WITH {_TOLD} SELECT id, {_TAG('tags')} AS html FROM p",
    "item_html": """
SELECT n_regionkey, string_agg('<li>' || n_name || '</li>', '' ORDER BY n_nationkey) AS html, '<ol>' || count(*) || '</ol>' AS counted FROM nation GROUP BY n_regionkey
""",
    "list_state": """
SELECT 'all' AS tag, CASE WHEN count(*) = 0 THEN 'no posts' ELSE 'posts' END AS state, least(count(*), 1)::BIGINT AS featured, greatest(count(*) - 1, 0)::BIGINT AS others FROM documents
UNION ALL SELECT 'none such', 'no posts', 0, 0
""",
    "hash_prefix": "SELECT event_id, event_id % 5 IN (1, 3) AS is_post FROM events",
    "tag_union": "SELECT lang AS tag FROM documents UNION SELECT source FROM documents",
    "typeahead_source": f"""
WITH m AS (
  SELECT p_partkey, p_name, CASE WHEN instr(lower(p_name), '{TYPED}') = 1 THEN 0 WHEN instr(p_name, '{TYPED}') > 0 THEN 1 ELSE 2 END AS c
  FROM part WHERE instr(lower(p_name), '{TYPED}') > 0 AND p_size % 2 = 0
), r AS (SELECT *, row_number() OVER (ORDER BY c, p_partkey) AS rank FROM m)
SELECT p_partkey, p_name, regexp_replace(p_name, '({TYPED})', '<strong>\\1</strong>', 'gi') AS html, rank FROM r WHERE rank <= {ITEMS}
""",
    "any_changed": """
SELECT l_orderkey, bool_or(CASE WHEN l_linenumber > 1 THEN l_linestatus END IS DISTINCT FROM CASE WHEN l_returnflag <> 'A' THEN l_linestatus END) AS changed
FROM lineitem GROUP BY l_orderkey
""",
    "cell_codes": """
SELECT p_partkey, (p_size % 8 || '' || p_partkey % 8)::INTEGER AS code, (p_size % 8)::INTEGER AS i, (p_partkey % 8)::INTEGER AS j FROM part
""",
    "other_player": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'O' ELSE 'X' END AS opponent FROM customer",
    "board_texts": f"""
WITH {_BOARDS} SELECT board_id, array_to_string(list_transform(range(8), lambda i: substr(b, 8 * i + 1, 8)), chr(10)) AS text FROM b
""",
    "board_cells": f"""
WITH {_BOARDS} SELECT board_id, 2 AS strategy, 'X' AS player, 3 AS depth, (k // 8)::INTEGER AS i, (k % 8)::INTEGER AS j, cell FROM cells
""",
    "board_moves": _MOVES + " SELECT board_id, cell::INTEGER AS cell, flipped, score::BIGINT AS score FROM m",
    "board_greedy": _MOVES + f"""
, best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY score DESC, cell) AS n FROM m WHERE score > {reversi.LEAST}) WHERE n = 1
)
SELECT x.board_id, x.player, x.cell::INTEGER AS cell, x.score::INTEGER AS score,
       string_agg(CASE WHEN c.k = x.k OR list_contains(ats, c.k) THEN x.player ELSE c.cell END, '' ORDER BY c.k) AS after
FROM best x JOIN cells c ON x.board_id = c.board_id GROUP BY x.board_id, x.player, x.cell, x.score
""",
}
