"""Reader edge cases on hand-written files (written under the checkpoint folder)."""

import os

from pyspark.sql import functions as F

from bindscape.sources import readers as RD
from bindscape.sources.writers import scratch_dir


def _write_text(spark, path, content):
    # one file holding ``content`` exactly (a single-row text write)
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def test_split_name_rules(spark):
    paths = ["/d/davis_train.csv", "/d/x_test_fold_0.csv", "/d/validation.csv", "/d/ligands_can.txt",
             "/d/proteins.txt", "/d/Y.txt", "/d/affinity.txt", "/d/other.csv", "/d/train.csv/part-0001.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(RD.split_name("p")).collect()]
    assert got == ["train", "test", "valid", "ligands", "proteins", "affinity", "affinity", "other", "train"]


def test_matrix_drops_unparsable_lines_and_shifts_rows(spark):
    root = scratch_dir(spark, "matrix-edge")
    _write_text(spark, os.path.join(root, "m"), "1 2 3\n4 x 6\n7 8 9\n")
    _write_text(spark, os.path.join(root, "single"), "5\n6\n")
    m = RD.read_matrix_txt(spark, os.path.join(root, "m"))
    got = sorted((r.i, r.j, r.affinity) for r in m.collect())
    assert got == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 7.0), (1, 1, 8.0), (1, 2, 9.0)]
    assert RD.read_matrix_txt(spark, os.path.join(root, "single")).count() == 0


def test_list_and_id_dict(spark):
    root = scratch_dir(spark, "list-edge")
    _write_text(spark, os.path.join(root, "ligands"), "\n  CCO\nCCN\n\n")
    lst = RD.read_list_txt(spark, os.path.join(root, "ligands"))
    assert sorted((r.idx, r.data) for r in lst.collect()) == [(0, "CCO"), (1, "CCN")]
    _write_text(spark, os.path.join(root, "proteins_dict"), '{"P1": "ACD", "P2": "EFG"}')
    d = RD.read_id_dict(spark, os.path.join(root, "proteins_dict"))
    assert sorted((r.protein_id, r.protein) for r in d.collect()) == [("P1", "ACD"), ("P2", "EFG")]


def test_flatten_protein_first_function_comment_wins(spark):
    js = ('{"primaryAccession": "Q1", "comments": [{"commentType": "FUNCTION", "texts": []}, '
          '{"commentType": "FUNCTION", "texts": [{"value": "later"}]}], "genes": []}')
    df = spark.createDataFrame([(js,)], "value string")
    r = df.select(RD.flatten_protein(F.from_json("value", RD.PROTEIN_JSON_SCHEMA)).alias("r")).first()["r"]
    assert r["uniprot_id"] == "Q1" and r["function"] == "" and r["gene_name"] == "" and r["length"] == 0
    assert r["keywords"] == []
