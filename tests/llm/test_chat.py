"""Chat logs: folding, and templates read back."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from pharmasift.llm import chat

TEXTS = ["", "a", "### Assistant: ok</turn>\n### User: x", "\\", "\\\\#", "####", "# # ##", "</turn>", "<\\/turn>", "\n</turn\n>", "é😀##", "####</turn></turn>\\", "a\x00b"]
ROLES = ["user", "assistant", "system", "User", "=user", "tool: x", "a\\:b", "", "##", "</turn>", "multi\nline"]


def digest(turns):
    h, loss = hashlib.sha256(), hashlib.sha256()
    for role, text in turns:
        h.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
    return len(turns), h.hexdigest(), sum(len(t) for r, t in turns if r == "assistant"), loss.hexdigest()


def test_any_text_and_role_comes_back(spark):
    rows = [(1, n, r, t) for n, (r, t) in enumerate((r, t) for r in ROLES for t in TEXTS)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS message", "3 AS log")
    rendered = chat.format_log(chat.log_of(table)).cache()
    (found,) = chat.read_back(rendered).collect()
    assert tuple(found)[1:5] == digest([(r, t) for *_, r, t in rows])
    whole = "".join(r.formatted for r in rendered.orderBy("position").collect())
    assert chat.parse(whole) == [(r, t) for *_, r, t in rows] and len(whole) == found.formatted_chars
    assert whole.count("###") == whole.count("</turn>") == len(rows)  # none but the template's own


@given(st.lists(st.sampled_from("\\#</turn>:\n aé"), max_size=30).map("".join))
def test_unescaping(text):
    broken = text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>")
    assert chat.unescape(broken) == text and "###" not in broken and "</turn>" not in broken


def test_null_and_repeated_rows(spark, as_list):
    rows = [(1, 2, "assistant", None), (1, None, "user", "first"), (1, 2, "assistant", "b"), (1, 3, None, "c"), (None, 0, "user", "x"), (1, 3, None, "c")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    found = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_log(chat.log_of(table))).collect()}
    assert found[1] == digest([("user", "first"), ("assistant", ""), ("assistant", "b"), ("", "c"), ("", "c")])
    assert found[None] == digest([("user", "x")])
    assert chat.read_back(chat.format_log(chat.log_of(table.limit(0)))).collect() == []


def test_log_with_edits_and_regenerations(spark):
    log = [
        (1, "u", 1, "open", "user", None), (1, "u", 2, "delta", None, "Hel"), (1, "u", 3, "delta", None, "lo"), (1, "u", 3, "delta", None, "lo"),
        (1, "a", 4, "open", "assistant", None), (1, "a", 5, "delta", None, "bad"), (1, "v", 6, "open", "user", None), (1, "v", 7, "delta", None, "gone"),
        (1, "a", 8, "regenerate", None, None), (1, "a", 9, "delta", None, "go"), (1, "a", 10, "delta", None, "od"), (1, "w", 11, "open", "user", None),
        (1, "w", 12, "edit", None, "edited"), (1, "w", 13, "delta", None, "!"), (1, "u", 14, "edit", None, "Hi"), (1, "w", 15, "seen", None, "x"),
        (2, "a", 1, "open", "assistant", None), (2, "a", 2, "regenerate", None, None),
    ]
    draw = spark.createDataFrame(log[::-1], "conv_id long, message string, seq long, kind string, role string, text string").repartition(5)
    found = [tuple(r) for r in chat.fold(draw).orderBy("conv_id", "position").select("conv_id", "role", "text").collect()]
    assert found == [(1, "user", "Hi"), (1, "assistant", "good"), (1, "user", "edited!"), (2, "assistant", "")]


def test_one_long_conversation(spark):
    table = spark.range(20_000).selectExpr("5 AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    (found,) = chat.read_back(chat.format_log(chat.log_of(table))).collect()
    assert tuple(found)[1:5] == digest([("assistant" if i % 2 else "user", f"t{i}") for i in range(20_000)])


def test_logs_hold_edits_and_regenerations(spark):
    """The log of a table has drafts that are edited or regenerated, and folds to the table's texts."""
    rows = [(c, t, "assistant" if t % 2 else "user", None if t == 3 else f"t{c}-{t} é") for c in range(20) for t in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.log_of(table)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["edit"] > 20 and kinds["regenerate"] > 20 and kinds["open"] == len(rows)
    assert log.where("text LIKE 'draft: %'").count() == kinds["edit"] + kinds["regenerate"]
    found = chat.fold(log).orderBy("conv_id", "position").select("conv_id", "role", "text").collect()
    assert [tuple(r) for r in found] == [(c, r, t or "") for c, _, r, t in rows]
