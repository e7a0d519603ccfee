import hashlib

from tabweave.llm import chat

MARK = "<|im_end|><|im_start|>assistant ok"


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    before, valid = None, True
    for r in rows:
        now = r[2] or ""
        valid &= now in {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}.get(before, ())
        before = now
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), valid


def test_digests_equal_brute_force(spark, monkeypatch):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", MARK), (1, 2, "assistant", "a\\b <| \\\\ <|im_start|>\n"),
        (2, 0, "user", None), (2, 0, "user", None), (2, 1, "assistant", ""),
        (3, None, "user", "late"), (3, 5, None, "x"), (3, -1, "odd\nrole\\", "y <"), (3, 4, "assistant", "|im_end|>"),
        (None, 0, "user", "no id"), (None, 1, "assistant", "é😀"),
        (4, 0, "assistant", "first"),
    ]
    rows += [(5, k, "user" if k % 2 == 0 else "assistant", f"turn {k} <|") for k in range(700)]
    turns = spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, state string, part int")
    for size in (256, 3):
        monkeypatch.setattr(chat, "BLOCK_TURNS", size)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) for r in chat.chat_digests(chat.format_chats(turns)).collect()}
        assert got == {c: expected([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert chat.chat_digests(chat.format_chats(turns.filter("1 = 0"))).count() == 0


def test_loss_covers_assistant_texts_only(spark):
    turns = spark.createDataFrame([(1, 0, "user", MARK), (1, 1, "assistant", MARK)], "conv_id long, turn long, role string, text string")
    parts = chat.format_chats(turns).orderBy("block", "place", "part").collect()
    whole = "".join(p.text for p in parts)
    assert whole.count("<|im_start|>") == 2 and whole.count("<|im_end|>") == 2
    assert [chat.unescape(p.text, chat.CHATML) for p in parts if p.loss] == [MARK]
