import pytest

from claimloom.operators import overlap
from claimloom.sources import readers


def write(folder, name, text):
    (folder / name).write_text(text)


def test_csv_bundle(spark, tmp_path):
    write(tmp_path, "sources.csv", "id,domain\n1,a.example\n2,b.example\n1,late.example\n")
    write(tmp_path, "assertions.csv", "source_id,claim_id\n1,10\n1,10\n2,10\n2,11\n")
    write(tmp_path, "claims.csv", "claim_id,product_id,attribute\n10,p,ram\n11,q,ram\n")
    write(tmp_path, "source_claims.csv", "source_id,claim_id,value\n1,10,8\n2,10,9\n1,10,9\n2,11,4\n2,99,4\n")
    graph = readers.load_csv_bundle(spark, str(tmp_path))
    assert {(r.source_id, r.domain) for r in graph.sources.collect()} == {(1, "late.example"), (2, "b.example")}
    assert graph.edges.count() == 3
    # the last row of source 1 for claim 10 says 9, which two of three rows say; claim 99 is unknown
    weights = {(r.source_id, r.claim_id): round(r.weight, 4) for r in graph.weights.collect()}
    assert weights == {(1, 10): 0.6667, (2, 10): 0.6667, (2, 11): 1.0}
    assert readers.lookup_source(graph.sources, "b.example") == 2
    with pytest.raises(ValueError):
        readers.lookup_source(graph.sources, "nowhere.example")


def test_csv_without_values_and_with_bad_number(spark, tmp_path):
    write(tmp_path, "sources.csv", "id,domain\n1,a.example\n")
    write(tmp_path, "assertions.csv", "source_id,claim_id\n1,10\n")
    assert readers.load_csv_bundle(spark, str(tmp_path)).weights is None
    write(tmp_path, "assertions.csv", "source_id,claim_id\nx,10\n")
    with pytest.raises(Exception, match="(?i)malformed|cast|failfast"):
        readers.read_assertions_csv(spark, str(tmp_path)).collect()


def test_literal_graph_and_stats(spark):
    graph = readers.literal_graph(spark, {1: [1, 2], 2: [1, 2], 4: [3, 4]})
    assert tuple(overlap.graph_stats(graph.edges).head()) == (3, 4, 6)


def test_parquet_reader(spark, tmp_path):
    spark.createDataFrame([(1, "x", 3)], "a int, b string, c int").write.parquet(str(tmp_path / "t"))
    assert readers.read_parquet(spark, str(tmp_path / "t"), ["b"]).columns == ["b"]
