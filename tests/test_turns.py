"""Turn records: which of the many fields a turn reads, and what its history carries."""

import pytest
from pyspark.sql import functions as F

from loomspark.plans import turns

SCHEMA = """ord long, id string, conversation_id string, filename string, question string, program_re string, answer string, exe_ans string, turn_ind int, pre_text array<string>, post_text array<string>,
table array<array<string>>, gold array<struct<raw_id:string,text:string>>, qa struct<question:string,program_re:string,answer:string,exe_ans:string>,
annotation struct<cur_dial:array<string>,dialogue_break:array<string>,turn_ind:int,cur_program:string,exe_ans:string,turn_program:array<string>,exe_ans_list:array<string>,answer_list:array<string>>"""
NAMES = ("ord id conversation_id filename question program_re answer exe_ans turn_ind pre_text post_text table gold qa annotation").split()
ANN = "cur_dial dialogue_break turn_ind cur_program exe_ans turn_program exe_ans_list answer_list".split()
FACT = "sales were 5000 and costs 3000"


def record(ord_, annotation=None, qa=None, **given):
    base = {"pre_text": [FACT], "post_text": [], "table": [["x"]], "gold": [("text_0", FACT)]} | given | {"ord": ord_}
    base["annotation"] = tuple((annotation or {}).get(n) for n in ANN) if annotation is not None else None
    base["qa"] = tuple((qa or {}).get(n) for n in ("question", "program_re", "answer", "exe_ans")) if qa is not None else None
    return tuple(base.get(n) for n in NAMES)


def target(program, answer):
    return f"Evidence:\n- {FACT}\n\nProgram: {program}\n\nAnswer: {answer}"


@pytest.fixture(scope="module")
def rows(spark):
    first, second, third = "what were the total sales in that year", "and what were the costs in that year", "so how much more was it than costs"
    ask = lambda *q: list(q)
    made = [
        record(1, id="a_0", annotation={"cur_dial": ask(first), "cur_program": "add(5000, 1)", "exe_ans": "5001"}),
        record(2, id="a_1", annotation={"cur_dial": ask(first, second), "cur_program": "add(3000, 1)", "exe_ans": "3001", "answer_list": ["x", "A1"], "turn_ind": 1}),
        # the first question is annotated otherwise than it was answered; the second isn't annotated
        record(3, id="a_2", annotation={"cur_dial": ask(first, second, third), "cur_program": "subtract(5000, 3000)", "exe_ans": "2000", "turn_program": ["add(5000, 2)"], "exe_ans_list": ["5002"], "answer_list": ["A0"]}),
        # asks again, and its answer stands in the history
        record(4, id="a_3", annotation={"cur_dial": ask(third, second, third), "cur_program": "subtract(5000, 3000)", "exe_ans": "2000"}),
        # no conversation: the file names it; the dialog stands in dialogue_break; wrong answer: no target for others
        record(5, id="", filename="f.pdf", turn_ind=1, annotation={"dialogue_break": ask("2018what were the sales", "and in2019 what were they"), "answer_list": ["1", "77"], "turn_program": ["add(5000, 1)"], "exe_ans_list": ["5001"]}, qa={"program_re": "add(5000, 1)", "exe_ans": "5001"}),
        record(6, id="", filename="f.pdf", turn_ind=2, question="never read", annotation={"cur_dial": ask("and in2019 what were they", "what else was there in it")}, program_re="add(1, const_2)", answer="A3", exe_ans="3"),
        record(7, id="lone", qa={"question": "what is there to see in it", "program_re": "add(1, 1)", "exe_ans": "2"}),
        record(8, id="broken_7", program_re="foo(", question=None),
    ]
    df = spark.createDataFrame(made, SCHEMA).repartition(3)
    return {r["ord"]: r.asDict(recursive=True) for r in turns.turn_records(df).collect()}


def test_inputs(rows):
    assert {k: (r["conversation_id"], r["turn_ind"]) for k, r in rows.items()} == {
        1: ("a", 0), 2: ("a", 1), 3: ("a", 2), 4: ("a", 3), 5: ("f.pdf", 1), 6: ("f.pdf", 2), 7: ("lone", -1), 8: ("broken", 7),
    }
    assert rows[5]["question"] == "and in 2019 what were they" and rows[5]["answer_norm"] == "5001" and "raw_answer_mismatch_with_answer_norm" in rows[5]["audit_flags"]
    assert rows[6]["program_canonical"] == "add(1, 2)" and rows[6]["question"] == "what else was there in it" and rows[6]["answer_norm"] == "3"
    assert rows[7]["program_executable"] == 2.0 and rows[8]["prompt"] == "" and rows[8]["quality_tier"] == "C"
    assert rows[2]["answer_norm"] == "3001" and rows[2]["quality_tier"] == "A"  # a placeholder is no answer


def test_history(rows):
    turn = lambda q, p, a: {"question": q, "target": target(p, a)}
    first, second, third = (rows[k]["question"] for k in (1, 2, 3))
    assert rows[1]["history"] == [] and not rows[1]["requires_history"] and rows[1]["history_dependency"] == "self_contained"
    assert rows[2]["history"] == [turn(first, "add(5000, 1)", "5001")]
    assert rows[3]["history"] == [turn(first, "add(5000, 2)", "5002"), turn(second, "add(3000, 1)", "3001")]
    assert rows[3]["full_turns"] == 2 and rows[3]["question_turns"] == 0 and rows[3]["history_dependency"] == "entity_carryover"
    assert rows[4]["repeated_questions"] == 1 and rows[4]["history"] == [turn(second, "add(3000, 1)", "3001")]
    assert rows[5]["history"] == [{"question": "2018 what were the sales", "target": None}]  # its wording is suspicious
    assert rows[6]["history"] == [{"question": "and in 2019 what were they", "target": None}] and rows[6]["question_turns"] == 1


def test_prompt(rows):
    assert f"Conversation history:\nQ: {rows[1]['question']}\n{target('add(5000, 1)', '5001')}\n\nText before table:\n- {FACT}" in rows[2]["prompt"]
    assert "Conversation history questions:\n- and in 2019 what were they\n\n" in rows[6]["prompt"]
    assert rows[1]["prompt"].endswith("Program: ...\nAnswer: ...") and f"\n\nCurrent question: {rows[1]['question']}\n\n" in rows[1]["prompt"]


def test_answer_in_history(spark):
    ask = ["what were the total sales in that year", "what were they once more in that year"]
    ann = {"cur_dial": ask, "cur_program": "add(5000, 1)", "exe_ans": "5001", "turn_program": ["add(5000, 1)"], "exe_ans_list": ["5001"], "answer_list": ["5001"]}
    r = turns.turn_records(spark.createDataFrame([record(1, id="z_1", annotation=ann)], SCHEMA)).first()
    assert r["answer_in_history"] and "current_answer_repeated_in_history" in r["semantic_audit_flags"] and "current_target_leaked_in_history" in r["audit_flags"]


def test_last_turns_only(spark):
    """Of a long dialog the last questions alone are looked up, and a conversation without rows gives none."""
    ask = [f"what was number {i} of the year" for i in range(30)]
    ann = {"cur_dial": ask, "turn_program": [f"add({i}, 1)" for i in range(29)], "exe_ans_list": [str(i + 1) for i in range(29)], "answer_list": [None] * 29}
    df = spark.createDataFrame([record(1, id="z_1", annotation=ann)], SCHEMA)
    r = turns.with_history(df, turns=4).first()
    assert [h["question"] for h in r["history"]] == ask[-5:-1] and [h["target"] for h in r["history"]] == [target(f"add({i}, 1)", i + 1) for i in range(25, 29)]
    assert turns.turn_records(df.where(F.lit(False))).count() == 0
