"""Every mention of a found name, domains that stay together, rows that cannot be told apart by 64 bits."""

import re

from propflow.llm import surrogates


def replaced(spark, *texts, key=b"k"):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_entities string")
    found = surrogates.replace_entities(frame, key)
    assert found.columns == ["doc_id", "text", "n_entities"]
    return [r.text for r in found.orderBy("doc_id").collect()]


def test_later_bare_mentions_get_the_same_name():
    found = surrogates.find_entities("Mrs. Anna Miller wrote. Later Miller met MILLER, Anna and a miller of Millerton.")
    assert [(kind.split("_")[0], value) for _, _, kind, value in found] == [
        ("given", "Anna"), ("last", "Miller"), ("last", "Miller"), ("last", "MILLER"), ("given", "Anna"),
    ]
    assert surrogates.find_entities("Miller met MILLER.") == []


def test_mentions_read_alike(spark):
    first, second = replaced(
        spark,
        "Mrs. Anna Miller wrote. Later Miller met MILLER. MR MILLER-OTT left.",
        "Herr Otto Straße und Dr. Иванов, dann Иванов; ИВАНОВ.",
    )
    assert not re.search("miller|anna", first, re.IGNORECASE) and "ванов" not in second.lower()
    given, last = re.match(r"Mrs\. (\w+) (\w+) wrote", first).groups()
    assert f"Later {last} met {last.upper()}." in first and given != last
    name = re.search(r"Dr\. (\w+),", second)[1]
    assert f"dann {name}; {name.upper()}." in second


def test_addresses_of_one_domain_stay_together(spark):
    (text,) = replaced(spark, "a@host.org b@host.org a@other.org c@host.org " + " ".join(f"{c}@one.org" for c in "abcdefghijklmnopqrstuvwxyz"))
    local, hosts = zip(*(x.split("@") for x in text.split()), strict=True)
    assert hosts[0] == hosts[1] == hosts[3] != hosts[2] and len(set(hosts)) == 3
    assert len(set(text.split())) == 30 and len(set(local[4:])) == 26
