"""Delimited files by position: differing headers are refused, foreign encodings keep quoted line breaks."""

import pytest

from millrace.sources import files as S


def test_differing_headers(spark, tmp_path):
    (tmp_path / "1.csv").write_text("note\na,b\n1,2\n")
    (tmp_path / "2.csv").write_text("note\nb,a\n3,4\n")
    with pytest.raises(ValueError, match="different headers"):
        S.read_csv(spark, str(tmp_path), skiprows=1)
    assert S.read_csv(spark, f"{tmp_path}/1.csv", skiprows=1).collect()[0].asDict() == {"a": 1, "b": 2}
    (tmp_path / "2.csv").write_text("note\na,b\n3,4\n")
    assert sorted(map(tuple, S.read_csv(spark, str(tmp_path), skiprows=1).collect())) == [(1, 2), (3, 4)]


def test_line_breaks_in_a_foreign_encoding(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('a,b\n1,"caf\xe9\nau lait"\n2,"€"\n'.encode("cp1252"))
    got = sorted(map(tuple, S.read_csv(spark, f"{tmp_path}/x.csv", encoding="cp1252").collect()))
    assert got == [(1, "caf\xe9\nau lait"), (2, "€")]
