import os

from treeledger.catalog import queries
from treeledger.session import BATCH_BYTES


def test_texts_reach_the_writer_in_small_batches(spark, tmp_path, monkeypatch):
    """A worker holds a bounded part of the texts, however many rows a task has."""
    whole, seen = queries._write_texts, str(tmp_path)

    def watched(root):
        write = whole(root)

        def run(batches):
            def counted():
                for n, batch in enumerate(batches):
                    with open(f"{seen}/{os.getpid()}-{n}-{len(batch)}", "w"):
                        pass
                    yield batch

            yield from write(counted())

        return run

    monkeypatch.setattr(queries, "_write_texts", watched)
    given = {name: spark.conf.get(name) for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    docs = spark.range(3000).selectExpr("concat('d', id % 7, '/', id, '.txt') AS path", "concat(id, repeat(' é', 7000)) AS text")
    root = queries._write_tree(docs)
    rows = [int(name.rsplit("-", 1)[1]) for name in os.listdir(seen)]
    assert sum(rows) == 3000
    assert max(rows) * 21_000 <= BATCH_BYTES + 21_000
    with open(f"{root}/d3/10.txt", "rb") as file:
        assert file.read() == ("10" + " é" * 7000).encode()
    assert given == {name: spark.conf.get(name) for name in given}
