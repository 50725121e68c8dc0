"""Thousands of conversations that begin with one turn."""

from millrace.llm import chat


def test_a_common_first_turn_stands_once(spark):
    n, kinds = 3000, 700
    rows = [r for i in range(n) for r in ((i, 0, "system", "You are a helpful assistant."), (i, 1, "user", f"question {i % kinds}"), (i, 2, "assistant", f"answer {i}"))]
    nodes, paths = chat.pack(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6))
    nodes, paths = {r["start"]: r for r in nodes.collect()}, {r["conv_id"]: r for r in paths.collect()}
    assert len(nodes) == 1 + kinds + n and len(paths) == n
    assert {p["path"][0] for p in paths.values()} == {0} and len({p["path"][1] for p in paths.values()}) == kinds
    assert sum(r["content"].count("helpful") for r in nodes.values()) == 1
    # The stream is gapless, and each turn stands behind those it attends to.
    ends = sorted((r["start"], r["end"]) for r in nodes.values())
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    for i, p in paths.items():
        before = 0
        for depth, start in enumerate(p["path"]):
            node = nodes[start]
            assert node["position"] == before and node["tree"] == 0
            # Ancestors side by side in the stream may be told as one interval.
            held = sorted((a["start"], a["end"]) for a in node["attends"])
            assert sum(b - a for a, b in held) == before
            assert all(any(a <= nodes[x]["start"] and nodes[x]["end"] <= b for a, b in held) for x in p["path"][:depth])
            before += node["end"] - node["start"]
        assert f"question {i % kinds}" in nodes[p["path"][1]]["content"] and f"answer {i}" in nodes[p["path"][2]]["content"]
