"""Feed and sitemap files as data sources: batch and stream give the same rows."""

import os

import pytest

from tidewire.sources import datasources

RSS = '<?xml version="1.0"?><rss><channel><title>c</title><item><title>A &amp; b</title><link> http://x/1 </link><pubDate>2024-01-01</pubDate><description><![CDATA[<p>d</p>]]></description></item><item><title/><guid>g2</guid></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>é</title><link rel="self" href="no"/><link href="http://y/1"/><updated>2024-02-01</updated><content type="xhtml"><div>some <b>bold</b></div></content></entry></feed>'
BROKEN = "<rss><channel><item><title>whole</title></item><item><title>broken & off</title></item></channel></rss>"
MAP = '<urlset xmlns="s"><url><loc>http://x/a</loc><lastmod>2024-01-05</lastmod></url><url><loc>http://x/b</loc></url></urlset>'
INDEX = "<sitemapindex><sitemap><loc>http://x/s.xml</loc></sitemap></sitemapindex>"


@pytest.fixture
def folder(tmp_path):
    for i, (name, text) in enumerate((("a/1.xml", RSS), ("b.xml", ATOM), ("c.xml", BROKEN), ("d.xml", ""), ("_e.xml", RSS), ("m/1.xml", MAP), ("m/2.xml", INDEX))):
        path = tmp_path / ("maps" if name.startswith("m/") else "feeds") / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (1_700_000_000 + i,) * 2)
    return tmp_path


def test_batches(spark, folder):
    datasources.register(spark)
    rows = spark.read.format("feed_files").load(f"{folder}/feeds")
    got = {(os.path.basename(r["file"]), r["place"]): tuple(r)[2:] for r in rows.collect()}
    assert got == {
        ("1.xml", 0): ("A & b", "http://x/1", "2024-01-01", "<p>d</p>"), ("1.xml", 1): (None, "g2", None, None),
        ("b.xml", 0): ("é", "http://y/1", "2024-02-01", "some bold"), ("c.xml", 0): ("whole", None, None, None),
    }
    assert rows.rdd.getNumPartitions() == 1 and spark.read.format("feed_files").option("bytesPerTask", 1).load(f"{folder}/feeds").rdd.getNumPartitions() == 4
    maps = spark.read.format("sitemap_files").load(f"file://{folder}/maps").select("kind", "loc", "lastmod").collect()
    assert sorted(map(tuple, maps), key=str) == [("sitemap", "http://x/s.xml", None), ("url", "http://x/a", "2024-01-05"), ("url", "http://x/b", None)]
    assert spark.read.format("feed_files").load(f"{folder}/none").count() == 0
    assert spark.read.format("feed_files").load(f"{folder}/feeds/b.xml").count() == 1


def test_large_documents(spark, folder):
    big = folder / "big.xml"
    big.write_text("<rss><channel>" + "".join(f"<item><title>t{i}</title><link>http://x/{i}</link></item>" for i in range(100_000)) + "</channel></rss>")
    datasources.register(spark)
    assert spark.read.format("feed_files").load(str(big)).selectExpr("count(distinct link)", "max(place)").first()[:] == (100_000, 99_999)


def test_a_stream_reads_each_file_once(spark, folder):
    datasources.register(spark)

    def run():
        source = spark.readStream.format("feed_files").load(f"{folder}/feeds")
        query = source.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(map(str, spark.read.parquet(f"{folder}/out").collect()))

    batch = lambda: sorted(map(str, spark.read.format("feed_files").load(f"{folder}/feeds").collect()))
    assert run() == batch() and run() == batch()
    (folder / "feeds" / "new.xml").write_text(ATOM)
    assert run() == batch() and len(batch()) == 5
