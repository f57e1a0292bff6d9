import os


from pharmasift.sources import messages, reports
from tests.conftest import rows


def write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="latin1") as f:
        f.write(content)


def test_read_reports_by_folder(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/2023/2023Q1/DRUG23Q1.txt", "primaryid$prod_ai\n1$ACETAMINOPHEN\\HYDROCODONE\n2$\n")
    write(f"{root}/2023/2023Q2/DRUG23Q2.txt", "primaryid$prod_ai\n3$CAFÉ \"X\"\n")
    write(f"{root}/2022/2022Q4/DRUG22Q4.txt", "primaryid$prod_ai\n4$OLD\n")
    write(f"{root}/2023/2023Q1/DEMO23Q1.txt", "primaryid$caseid\n1$1\n")
    everything = reports.read_reports(spark, root, "DRUG")
    assert rows(everything, "primaryid", "prod_ai", "source_quarter") == [
        ("1", "ACETAMINOPHEN\\HYDROCODONE", "2023Q1"), ("2", None, "2023Q1"),
        ("3", 'CAFÉ "X"', "2023Q2"), ("4", "OLD", "2022Q4"),
    ]
    assert rows(reports.read_reports(spark, root, "DRUG", year=2023, quarters=[2]), "primaryid") == [("3",)]
    counts = reports.entity_counts({"DRUG": everything, "DEMO": reports.read_reports(spark, root, "DEMO")})
    assert ("DRUG", "2023Q1", 2) in rows(counts)
    missing = reports.missing_entities(counts, ("DEMO", "DRUG"))
    assert rows(missing, "entity", "source_quarter") == [("DEMO", "2022Q4"), ("DEMO", "2023Q2")]


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/2023/2023Q1/DRUG23Q1.txt", "primaryid$caseid$role_cod\n1$10$PS\n")
    write(f"{root}/2023/2023Q2/DRUG23Q2.txt", "role_cod$primaryid$caseid$dose\nSS$2$20$5\n")
    got = reports.read_reports(spark, root, "DRUG")
    assert rows(got, "primaryid", "caseid", "role_cod", "dose", "source_quarter") == [
        ("1", "10", "PS", None, "2023Q1"), ("2", "20", "SS", "5", "2023Q2"),
    ]


def test_unpublished_periods(frame):
    new = frame([(1, "2023Q1"), (2, "2023Q2")], "primaryid long, source_quarter string")
    old = frame([(9, "2023Q1"), (8, None)], "primaryid long, source_quarter string")
    assert rows(reports.unpublished(new, old), "primaryid") == [(2,)]
    assert reports.unpublished(new, old, force=True).count() == 2


def test_parse_drops_what_cannot_be_used(frame):
    raw = frame(
        [('{"primaryid":"1","caseid":" 7 ","caseversion":"2","fda_dt":"20230101","source_quarter":"2023Q1"}',),
         ('{"primaryid":"2","caseid":"8","caseversion":"x","fda_dt":"","source_quarter":"2023Q2"}',),
         ('{"primaryid":null,"caseid":"8"}',), ('{"primaryid":"5"}',), ("broken {",), ('{"primaryid":"abc","caseid":"1"}',), (None,)],
        "value string",
    )
    demo = messages.parse_entity(raw, messages.SPECS["DEMO"])
    assert rows(demo) == [(1, 7, 2, "20230101", "2023Q1"), (2, 8, None, None, "2023Q2")]
    assert messages.parse_entity(raw, messages.SPECS["DEMO"], "2023Q1").count() == 1
    reac = frame([('{"primaryid":"1","pt":"  "}',), ('{"primaryid":"1","pt":"Coma"}',)], "value string")
    assert rows(messages.parse_entity(reac, messages.SPECS["REAC"]), "pt") == [("Coma",)]


def test_messages_keep_nulls_and_round_trip(spark, frame, tmp_path):
    drug = frame([(1, None, "PS", "A\\B", None, "2023Q1")], "primaryid long, caseid long, role_cod string, prod_ai string, drugname string, source_quarter string")
    sent = messages.to_messages(drug)
    assert '"drugname":null' in sent.first()[0]
    sent.write.text(str(tmp_path / "m"))
    read = messages.read_text(spark, str(tmp_path / "m"), limit=5)
    assert rows(messages.parse_entity(read, messages.SPECS["DRUG"])) == rows(drug)


def test_topic_reader_is_a_kafka_scan(spark):
    try:
        messages.read_topic(spark, "localhost:1", "faers_demo")
    except Exception as error:  # the connector jar is not bundled
        assert "kafka" in str(error).lower()
    assert messages.TOPICS["OUTC"] == "faers_outc"
