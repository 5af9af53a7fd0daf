from collections import defaultdict

from keytally.llm import chat

TURNS = [
    (1, 0, "system", "be nice"), (1, 1, "ann", "hi <|im_end|> é"), (1, 2, "bob b", None), (1, 3, "cy", ""), (1, 3, "ann", "z"),
    (1, None, "ann", "first"), (1, 700, "ann", "later"), (1, 700, "ann", "later"),
    (2, 0, "system", "alone"), (3, 0, None, "who"), (3, 1, "", "me"), (None, 0, "ann", "x"), (None, 1, "user", "y"),
]


def _rendered(turns):
    by_conv, names, used = defaultdict(list), {}, set()
    for conv, role in sorted({(t[0], t[2]) for t in turns}, key=lambda x: (str(x[0]), x[1] is not None, x[1] or "")):
        plain = "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in role or "") or "unknown"
        tries = [plain, *(f"{plain}#{k}" for k in range(2, 99))]
        names[conv, role] = next(t for t in tries if (conv, t) not in used)
        used.add((conv, names[conv, role]))
    for conv, turn, role, text in turns:
        by_conv[conv].append((-1 if turn is None else turn, names[conv, role], (text or "").replace("<|im_", "<| im_")))
    for conv, rows in by_conv.items():
        for person in {s for _, s, _ in rows} - {"system", "tool"}:
            whole, masks = "", []
            for _, speaker, said in sorted(rows):
                head = {"system": "system", "tool": "tool", person: "assistant"}.get(speaker, f"user name={speaker}")
                whole += f"<|im_start|>{head}\n"
                if speaker == person:
                    masks.append((len(whole), len(whole) + len(said) + len("<|im_end|>")))
                whole += f"{said}<|im_end|>\n"
            yield (conv, person), (whole, masks)


def test_segments_in_order_are_the_dialogue(spark):
    frame = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    rows = chat.perspectives(frame.selectExpr("*", "1 head", "2 perspective"), stretch=3).collect()
    parts = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        parts[r["conv_id"], r["perspective"]].append(r)
    want = dict(_rendered(TURNS))
    assert set(parts) == set(want)
    for key, own in parts.items():
        whole, masks = want[key]
        assert "".join(r["segment"] for r in own) == whole
        assert all(whole[r["start"] : r["end"]] == r["segment"] for r in own)
        assert [(r["mask_start"], r["mask_end"]) for r in own if r["mask_start"] is not None] == masks
    assert chat.perspectives(frame.limit(0)).count() == 0


ALIKE = [
    (1, 0, "李雷", "你好"), (1, 1, "韩梅", "hi"), (1, 2, "a b", "x"), (1, 3, "a_b", "y"), (1, 4, None, "z"), (1, 5, "unknown", "q"),
    (1, 6, "", "w"), (1, 7, "李雷", "ok"), (2, 0, "韩梅", "alone"), (None, 0, "a b", "n"), (None, 1, "a.b", "m"),
]


def test_speakers_with_like_names_stay_apart(spark):
    frame = spark.createDataFrame(ALIKE, "conv_id bigint, turn bigint, role string, text string")
    rows = chat.perspectives(frame).collect()
    assert len({r["perspective"] for r in rows if r["conv_id"] == 1}) == 7
    want = dict(_rendered(ALIKE))
    for key, (whole, masks) in want.items():
        own = sorted((r for r in rows if (r["conv_id"], r["perspective"]) == key), key=lambda r: r["start"])
        assert "".join(r["segment"] for r in own) == whole
        assert [(r["mask_start"], r["mask_end"]) for r in own if r["mask_start"] is not None] == masks
    taught = {r["perspective"]: r["segment"] for r in rows if r["conv_id"] == 1 and r["mask_start"] is not None and r["turn"] in (0, 1)}
    assert len(taught) == 2  # neither speaker learns the other's words
