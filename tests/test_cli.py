import json

from corpuslens import __main__ as cli
from corpuslens import fixed_values as fv


def test_commands(spark, tmp_path, monkeypatch, capsys):
    questions = [{"id": i, "split": "s", "cancer": "c", "question": f"question {i}", "correct_answer": i % 2 == 0}
                 for i in range(4)]
    (tmp_path / "q.json").write_text(json.dumps(questions))
    for condition in fv.CONDITIONS:
        folder = tmp_path / condition
        folder.mkdir()
        for prompt in fv.PROMPTS:
            (folder / f"answers_{prompt}.csv").write_text("question_id,answer\n" + "".join(f"{i},true\n" for i in range(4)))
    cli.main(["analyse", "--questions", str(tmp_path / "q.json"), "--rag-dir", str(tmp_path / "rag"),
              "--non-rag-dir", str(tmp_path / "non_rag"), "--output", str(tmp_path / "out")])
    assert (tmp_path / "out" / "metrics" / "_SUCCESS").exists()

    (tmp_path / "rag" / "answers_basic.csv").write_text("question_id,answer\n")
    cli.main(["evaluate", "--questions", str(tmp_path / "q.json"), "--results-dir", str(tmp_path / "rag")])
    printed = capsys.readouterr().out
    assert "basic,0,0.0000,N/A" in printed and "\noncology_expert,4,1.0000,0.5000," in printed
    assert "under all prompts: 0" in printed

    monkeypatch.setenv("LLM_BASE_URL", "http://127.0.0.1:9/v1")  # nothing listens there
    left = cli.main(["answer", "--questions", str(tmp_path / "q.json"), "--output", str(tmp_path / "run"),
                     "--first", "2", "--prompts", "basic", "--max-attempts", "1"])
    assert left == 1
