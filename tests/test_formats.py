import glob

import pytest

from critpath.operators import prep
from critpath.sources import readers, writers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_text_formats(spark, tmp_path):
    got = readers.edge_list(spark, write(tmp_path / "a", "# 3 4\n1 2 x\n2 3\n\n3 3\n")).orderBy("line").collect()
    assert [(r.u, r.v) for r in got] == [(0, 1), (1, 2), (2, 2)]
    got = readers.single_criterion(spark, write(tmp_path / "b", "3 4\n0 1 7\n1 2 1000000\n")).orderBy("line").collect()
    assert [(r.u, r.v, r.w) for r in got] == [(0, 1, 7), (1, 2, None)]
    d = write(tmp_path / "d", "c hi\np sp 3 2\na 1 2 5\na 2 3 6\n")
    t = write(tmp_path / "t", "p sp 3 2\na 1 2 8\na 2 3 9\n")
    assert sorted(map(tuple, readers.dimacs_pair(spark, d, t).collect())) == [(0, 1, [5, 8]), (1, 2, [6, 9])]
    m, names = readers.dimacs_multi(spark, write(tmp_path / "m", "p sp 3 2\np criteria 2 Distance Time\na 1 2 5 8\na 2 3 6 1000000\n"))
    assert names == ["Distance", "Time"] and [r.weights for r in m.orderBy("line").collect()] == [[5, 8], [6, None]]
    w, names = readers.whole_stream(spark, write(tmp_path / "w", "3 2 2 A B\n1 2 5 8 2\n3 6 7\n"))
    assert names == ["A", "B"] and sorted((r.u, r.v, r.weights) for r in w.collect()) == [(0, 1, [5, 8]), (1, 2, [6, 7])]
    x, names = readers.multiplex(spark, write(tmp_path / "x", "4 2 P Q\n1 0 1 3\n2 1 0 4\n1 1 0 9\n1 2 2 5\n2 2 3 0\n"))
    assert names == ["P", "Q"] and [tuple(r) for r in x.collect()] == [(0, 1, [9, 4])]
    assert [tuple(r) for r in readers.od_pairs(spark, write(tmp_path / "o", "3\n1 2\n3 4\n5 6\n"), limit=2).orderBy("query_id").collect()] == [(0, 1, 2), (1, 3, 4)]
    assert sorted(map(tuple, readers.metis_parts(spark, write(tmp_path / "p", "0\n1\n0\n")).collect())) == [(0, 0), (1, 1), (2, 0)]


def test_arcs_of_one_file_only_are_an_error(spark, tmp_path):
    d = write(tmp_path / "d", "p sp 3 1\na 1 2 5\n")
    t = write(tmp_path / "t", "p sp 3 2\na 1 2 8\na 2 3 9\n")
    for pair in ((d, t), (t, d)):
        with pytest.raises(Exception, match="one of the two tables"):
            readers.dimacs_pair(spark, *pair).collect()
    assert readers.dimacs_range(spark, t)[1] == (8, 9) and readers.head(spark, t, 1) == ["p sp 3 2"]


def test_a_folder_of_files_keeps_their_order(spark, tmp_path):
    (tmp_path / "f").mkdir()
    write(tmp_path / "f" / "a", "3 9\n0 1 7\n")
    write(tmp_path / "f" / "b", "".join(f"1 2 {i}\n" for i in range(3000)))
    write(tmp_path / "f" / "c", "0 2 5\n")
    got = readers.single_criterion(spark, str(tmp_path / "f")).orderBy("line").collect()
    assert [r.w for r in got] == [7, *range(3000), 5]
    assert sorted(map(tuple, readers.metis_parts(spark, write(tmp_path / "p", "0\n\n1\n")).collect())) == [(0, 0), (2, 1)]


def test_round_trips(spark, tmp_path):
    und = spark.createDataFrame([(0, 1, [3, None]), (1, 2, [4, 5]), (0, 2, [1, 1])], "u long, v long, weights array<int>")
    e = prep.mirror(und)
    writers.text(writers.multi_lines(e), f"{tmp_path}/mc", ["src", "dst"], ["3 6", "2 A B"])
    back, names = readers.multi_criteria(spark, glob.glob(f"{tmp_path}/mc/part*")[0])
    assert names == ["A", "B"] and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, e.collect()), key=str)
    parts = spark.createDataFrame([(0, 0, 0), (2, 0, 1), (1, 1, 0)], "v long, pid int, pos long")
    writers.text(writers.partition_lines(parts), f"{tmp_path}/info", ["pid"], ["3 6", "A B", "2"])
    assert sorted(map(tuple, readers.partition_info(spark, glob.glob(f"{tmp_path}/info/part*")[0]).collect())) == sorted(map(tuple, parts.collect()))
    tags = spark.createDataFrame([(0, 0, 1), (2, 0, 2), (1, 1, 2)], "v long, pid int, tag tinyint")
    writers.text(writers.boundary_lines(tags), f"{tmp_path}/bd", ["pid"], ["2"])
    assert sorted(map(tuple, readers.boundary(spark, glob.glob(f"{tmp_path}/bd/part*")[0]).collect())) == sorted(map(tuple, tags.collect()))
    for r in writers.binary_partitions(e, parts).collect():
        (tmp_path / f"b{r.pid}.bin").write_bytes(r.content)
    back = readers.binary_partitions(spark, f"{tmp_path}/b*.bin", 2)
    assert sorted(((r.src, r.dst, r.weights) for r in back.collect()), key=str) == sorted(map(tuple, e.collect()), key=str)
    writers.table(parts, f"{tmp_path}/t", by="pid")
    writers.table(parts.limit(0), f"{tmp_path}/t", by="pid", mode="ignore")
    assert spark.read.parquet(f"{tmp_path}/t").where("pid = 0").count() == 2
    assert sorted(r.line for r in writers.metis_lines(e, "pri").collect()) == ["1 1 2 4", "1 3 3 4", "2 3 3 1"]
    assert sorted(r.line for r in writers.multiplex_lines(und).collect()) == ["1 0 1 3", "1 0 2 1", "1 1 2 4", "2 0 2 1", "2 1 2 5"]
