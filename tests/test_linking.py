from rasterloom import catalogue
from rasterloom.sources.adapters import EPOCHS

SF = "/root/testdata/sf0.001"


def test_registered_links_read_every_epoch(spark):
    for name in ("link_emi", "link_evd", "link_tiled"):
        got = catalogue.QUERIES[name](spark, SF).groupBy("row", "col").count().collect()
        assert got and {r["count"] for r in got} == {EPOCHS}
