import gzip
import json

from stemma.sources import sequences


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACD\nEF\n>two\n\nGG \n>empty\n")
    records = sequences.read_fasta(spark, str(tmp_path / "a.fa"))
    assert rows(records, "name", "seq") == [("empty", ""), ("one", "ACDEF"), ("two", "GG")]
    sequences.write_fasta(records, str(tmp_path / "out"), wrap=2)
    assert rows(sequences.read_fasta(spark, str(tmp_path / "out")), "name", "seq") == [("empty", ""), ("one", "ACDEF"), ("two", "GG")]


def test_stockholm_joins_wrapped_blocks(spark, tmp_path):
    text = "# STOCKHOLM 1.0\n#=GF ID x\n#=GC RF xx\n#=GS b DE some words here\n#=GR b SS HH\nb  AC-\na  A.C\n\nb  DD\na  EE\n#=GC RF yy\n#=GR b SS EE\n//\n"
    with gzip.open(tmp_path / "fam1.sto.gz", "wt") as f:
        f.write(text)
    assert rows(sequences.read_stockholm(spark, str(tmp_path)), "fam", "row_idx", "name", "aln") == [("fam1", 0, "b", "AC-DD"), ("fam1", 1, "a", "A.CEE")]
    found = {(r.kind, r.name, r.tag): r.value for r in sequences.read_stockholm_annotations(spark, str(tmp_path)).collect()}
    assert found == {("GC", None, "RF"): "xxyy", ("GS", "b", "DE"): "some words here", ("GR", "b", "SS"): "HHEE"}


def test_newick_round_trip(spark, tmp_path):
    (tmp_path / "t1.nwk").write_text("((a:1,'b c':2.5)x:0.5,d:3)root;")
    edges = sequences.read_newick(spark, str(tmp_path))
    found = {r.name: r for r in edges.collect()}
    assert found["a"].parent_id == found["x"].node_id and found["x"].parent_id == found["root"].node_id and found["root"].parent_id is None
    assert found["b c"].branch_length == 2.5 and found["a"].depth == 2 and found["d"].is_leaf and not found["x"].is_leaf
    assert sequences.write_newick(edges).collect()[0].newick == "((a:1,b c:2.5)x:0.5,d:3)root;"
    assert sequences.newick_edges(None) == [] and sequences.newick_edges("a;")[0][2] == "a"


def test_pairs_splits_clans_assays(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps({"x": "AC", "a": "M2", "y": "AD", "t": 0.5, "fam": "f", "id": "1"}) + "\n")
    assert rows(sequences.read_pairs(spark, str(tmp_path / "p.jsonl")), "x", "a", "t", "fam") == [("AC", "M2", 0.5, "f")]
    (tmp_path / "s.json").write_text(json.dumps({"train": ["a", "b"], "test": ["c"]}))
    assert rows(sequences.read_split(spark, str(tmp_path / "s.json")), "split", "fam") == [("test", "c"), ("train", "a"), ("train", "b")]
    (tmp_path / "c.tsv").write_text("f1\tc1\nf2\t\n")
    assert rows(sequences.read_clans(spark, str(tmp_path / "c.tsv")), "fam", "clan") == [("f1", "c1"), ("f2", "f2")]
    (tmp_path / "d.csv").write_text("mutant,mutated_sequence,DMS_score\nx,AC,1.5\n")
    assert rows(sequences.read_assays(spark, str(tmp_path / "d.csv")), "mutated_sequence", "DMS_score") == [("AC", 1.5)]
