"""Every operator's SQL runs, and gives the operator's rows."""

import pytest
from sql import rows_of_spark, rows_of_sql

from mnemoscope.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert rows_of_spark(queries.QUERIES[name](spark, SF)) == rows_of_sql(queries.ORACLE_SQL[name], SF)


def test_secret_rules_in_sql(spark, tmp_path, hard):
    """Spans of all rules, those of the method too, on texts made for them."""
    key = "-----BEGIN RSA PRIVATE KEY-----"
    texts = [
        f"{key}\nabc\ndef\n", f"{key} abc def", f"{key}\nabcdefghijklmnopqrst zz", f"{key}\\nabc\\nde -----END RSA PRIVATE KEY-----x", f"{key}\nProc-Type: 4\nab  \ncd", f"{key} ----x-----END RSA PRIVATE KEY-----",
        f"{key}\na-b------END PRIVATE KEY-----", key + key, f"p {key}\nab\n{key}\nxy", "https://a:b@c ://u:pw@ ://x:y z@", "gh" + "p_" + "a1B2" * 9 + " xox" + "b-12345-abcde " + "eyJ" + "abcdefgh1.eyJ" + "abcdefgh2.abcdefgh_3",
    ]
    docs = hard.select("doc_id", "text").dropDuplicates(["doc_id"]).union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got, expected = rows_of_spark(queries.op6_secret_scan(spark, str(tmp_path))), rows_of_sql(queries.ORACLE_SQL["op6_secret_scan"], str(tmp_path))
    assert got == expected and sum("private_key" in r[-1] for r in got[1]) == 9
