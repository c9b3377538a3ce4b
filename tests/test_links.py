"""Links of items with more than a page of them."""
from portcullis.operators import links as L
from portcullis.operators.profiles import Profile, Settings


def test_links_of_one_page(spark):
    hits = spark.createDataFrame([("a", i, f"tag: a{i}.com") for i in range(5)] + [("b", 0, "tag: b.com")], "item_id string, rank long, hit string")
    p = Settings.of(Profile.load("homelab"))
    assert [r.item_id for r in L.links_in_attrs(hits, p, page=3, larger=False).collect()] == ["b"]
    assert sorted(r.item_id for r in L.links_in_attrs(hits, p, page=3).collect()) == ["a", "a", "b"]
