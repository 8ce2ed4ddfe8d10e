import json

import pytest

from quern.operators import relational
from quern.sources import boards, listings, posts

HEAD = "<Listing><Location><StreetAddress>1 A St</StreetAddress><City>X</City><State>CA</State><Zip>01234</Zip><Lat> 34.5</Lat><Long>\t-118.25</Long></Location>"
TAIL = "<ListingDetails><Status>Active</Status><Price>2195000</Price><ListingUrl>http://a/?b&amp;c</ListingUrl><Image>p.jpg</Image></ListingDetails></Listing>"
GOOD = HEAD + TAIL
EMPTY = "<Listing><Location><StreetAddress/><City/><State> </State><Zip>  </Zip><Lat/><Long/></Location>" + TAIL


def parsed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, xml string")
    return listings.parse(df)


@pytest.mark.parametrize(
    ("text", "status"),
    [
        (f"<Listings>{GOOD * 6}</Listings>", "ok"),
        (f'<?xml version="1.0"?>\n<Listings>\n{GOOD}\n</Listings>\n<!-- end -->\n', "ok"),
        ("<Listings></Listings>", "no listings"),
        ("<Listings/>", "no listings"),
        ("<Listings> \n </Listings>", "no listings"),
        (f"<Listings>{GOOD}{HEAD}</Listings>", "invalid"),
        (f"<Listings>{GOOD}", "invalid"),
        (f'\n<?xml version="1.0"?><Listings>{GOOD}</Listings>', "invalid"),
        (f"<Listings>{GOOD.replace('&amp;', '&')}</Listings>", "invalid"),
        (f"<Listings>{GOOD}</Listings>junk", "invalid"),
        (f"<Listings>{GOOD}</Listings><Listings/>", "invalid"),
        ("", "invalid"),
        (None, "invalid"),
        ("no xml", "invalid"),
    ],
)
def test_documents_are_accepted_or_rejected_whole(spark, text, status):
    (row,) = parsed(spark, text).collect()
    assert row.status == status and (row.listings is not None) == (status == "ok")


def test_values_stay_raw_and_blank_cells_show_as_such(spark):
    rows = listings.row_html(listings.typed(listings.flatten(parsed(spark, f"<Listings>{GOOD}{EMPTY}</Listings>")))).orderBy("pos").collect()
    a, b = rows
    assert (a.Zip, a.Lat, a.Long, a.ListingUrl) == ("01234", " 34.5", "\t-118.25", "http://a/?b&c")
    assert (a.latitude, a.longitude, int(a.amount)) == (34.5, -118.25, 2195000) and b.latitude is None
    assert b.html.count("<td>&nbsp;</td>") == 5 and "<td>  </td>" in b.html
    assert '<a href="http://a/?b&amp;c">' in a.html


def test_listing_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f"<Listings>{GOOD * 2}</Listings>")
    (tmp_path / "b.xml").write_text(f"<Listings>{GOOD}")
    got = {r.file.rsplit("/", 1)[1]: r.status for r in listings.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.xml": "ok", "b.xml": "invalid"}
    assert listings.flatten(listings.read_documents(spark, str(tmp_path))).count() == 2


def test_posts(spark, tmp_path):
    body = {"posts": [{"id": 2, "title": 'a & "b"', "content": "<p>x</p>", "tags": ["s", "t", "u"]}, {"id": 1}], "meta": {"total_posts": 2}}
    (tmp_path / "p.json").write_text(json.dumps(body, indent=1))
    p = posts.read_posts(spark, str(tmp_path / "p.json"))
    assert [(r.pos, r.id, r.tags) for r in p.orderBy("pos").collect()] == [(0, 2, ["s", "t", "u"]), (1, 1, None)]
    assert posts.check_meta(spark, str(tmp_path / "p.json")).first().agrees
    cards = relational.cards(p, 2).orderBy("pos").collect()
    assert [c.tags for c in cards] == [["s", "t"], []] and [c.read_min for c in cards] == [1, 1]
    html = relational.card_html(p).orderBy("pos").first().html
    assert "<h2>a &amp; &quot;b&quot;</h2>" in html and html.count('class="tag"') == 3
    hashes = spark.createDataFrame([("#post-1",), ("#post-9",), ("",)], "hash string")
    assert {r.hash: (r.post_pos, r.is_listing) for r in relational.route(p, hashes).collect()} == {"#post-1": (1, False), "#post-9": (None, True), "": (None, True)}


@pytest.mark.parametrize("text", ["{}", '{"posts": []}', '{"posts": null}'])
def test_no_posts(spark, tmp_path, text):
    (tmp_path / "p.json").write_text(text)
    assert posts.read_posts(spark, str(tmp_path / "p.json")).count() == 0


def test_unreadable_posts(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        posts.read_posts(spark, str(tmp_path / "none.json")).count()
    assert posts.read_posts(spark, str(tmp_path / "none.json"), on_error="empty").count() == 0
    (tmp_path / "bad.json").write_text('{"posts": [')
    assert posts.read_posts(spark, str(tmp_path / "bad.json"), on_error="empty").count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        posts.read_posts(spark, str(tmp_path / "bad.json")).collect()


def test_joined_items(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"owl": [{"item": "<b>1</b>"}, {"item": null}, {"item": "2"}]}')
    assert posts.gather_items(spark, str(tmp_path / "o.json")).first().html == "<b>1</b>2"


def test_boards_and_graphs(spark, tmp_path):
    lines = ["*" * 8] * 3 + ["***OX***", "***XO***"] + ["*" * 8] * 3
    (tmp_path / "b.txt").write_text("2 X 1\n" + "\n".join(lines) + "\n")
    b = boards.read_boards(spark, str(tmp_path / "b.txt"))
    assert b.count() == 64 and {(r.strategy, r.player, r.depth) for r in b.collect()} == {(2, "X", 1)}
    assert boards.board_text(b).first().text == "\n".join(lines)
    (tmp_path / "short.txt").write_text("2 X 1 ***")
    with pytest.raises(Exception, match="no board"):
        boards.read_boards(spark, str(tmp_path / "short.txt")).collect()
    (tmp_path / "g.txt").write_text("2\nP\nQ\n3\nP\nQ\nR\n0 4 0\n4 0 1\n0 1 0\n")
    nodes, edges = boards.read_graph(spark, str(tmp_path / "g.txt"))
    assert sorted((r.i, r.name) for r in nodes.collect()) == [(0, "P"), (1, "Q"), (2, "R")]
    assert sorted((r.src, r.dst, r.w) for r in edges.collect()) == [(0, 1, 4), (1, 0, 4), (1, 2, 1), (2, 1, 1)]
