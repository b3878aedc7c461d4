from vellum import cli


def test_build_and_read_a_graph(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda **_: spark)
    (tmp_path / "p").mkdir()
    (tmp_path / "t").mkdir()
    (tmp_path / "p" / "a.md").write_text("## 2024-05-01\n### KB-2024-05-01-01 | Gully erosion by kriging\n- **一句话:** gully erosion with kriging\n### KB-2024-05-01-02 | Snow\n- **一句话:** snow\n")
    (tmp_path / "t" / "a.md").write_text("### A-001｜沟谷侵蚀（gully erosion）\n- **解释:** e\n")
    g = str(tmp_path / "g")
    assert cli.main(["build", "--papers", str(tmp_path / "p"), "--terms", str(tmp_path / "t"), "--graph", g]) == 0
    for args in (["stats"], ["query", "gully"], ["ask", "gully", "erosion"], ["show", "KB-2024-05-01-01"], ["path", "KB-2024-05-01-01", "A-001"], ["recommend", "A-001"], ["health"], ["mermaid"], ["canvas"]):
        assert cli.main([*args, "--graph", g]) == 0
    out = capsys.readouterr().out
    assert "A-001" in out and "graph LR" in out and "INTRODUCES" in out


def test_engines(capsys):
    assert cli.main(["engines"]) == 0
    assert "streams" in capsys.readouterr().out
