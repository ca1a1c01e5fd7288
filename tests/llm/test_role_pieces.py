"""Role repair of conversations that lie in several tasks or pieces, against a plain repair of each conversation."""

import random
from collections import Counter

from flowledger.llm import chat


def plain(roles):
    """(action, role, inserted) of each turn: costs forward over all turns, first cheapest move from the last one back."""
    codes = [chat.ROLES.get(x, chat.UNKNOWN) for x in roles]
    costs = [{chat.START: 0}]
    for code in codes:
        new = {}
        for a, b, k, *_ in chat._moves(code):
            if a in costs[-1]:
                new[b] = min(new.get(b, 10**9), costs[-1][a] + k)
        costs.append(new)
    state = min(costs[-1], key=lambda s: (costs[-1][s] + chat.INSERT * len(chat.closing(s)), s))
    added, out = chat.closing(state), []
    for code, here, there in zip(codes[::-1], costs[-2::-1], costs[:0:-1], strict=True):
        a, b, _, action, way = next(m for m in chat._moves(code) if m[1] == state and m[0] in here and here[m[0]] + m[2] == there[state])
        out.append((action, chat.NAMES[b], ",".join(chat.NAMES[s] for s in (*way, *added))))
        state, added = a, ()
    return out[::-1]


def conversations():
    r = random.Random(11)
    pick = ["system", "user", "assistant", "tool", None]
    rows = [(c, t, r.choice(pick), f"c{c}t{t}") for c in range(60) for t in range(r.randrange(1, 12))]
    rows += [(1000, t, r.choice(pick), f"long {t}") for t in range(700)]
    rows += [(None, t % 3, r.choice(["user", "assistant"]), f"null {t}") for t in range(300)]
    rows += [(2000, None, "user", None)] * 200 + [(2000, 5, "assistant", "x")] * 40
    r.shuffle(rows)
    return rows


def key(conv):
    return (conv is not None, conv or 0)


def test_pieces_and_tasks_change_nothing(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    results = []
    for segment, tasks in ((128, 3), (7, 8), (1, 5)):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        held = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
        try:
            got = chat.repaired(df.repartition(tasks), segment).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", held)
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        results.append(Counter(got))
        whole = {}
        for x in sorted(got, key=lambda x: (key(x.conv_id), key(x.turn), x.place)):
            whole.setdefault(x.conv_id, []).append(x)
        assert Counter((x.conv_id, x.turn, x.old_role) for x in got) == Counter((c, t, role) for c, t, role, _ in rows)
        for turns in whole.values():
            assert [(x.action, x.role, x.inserted) for x in turns] == plain([x.old_role for x in turns])
            places = Counter((x.turn, x.place) for x in turns)
            assert set(places.values()) == {1}
            assert all(p == 0 or (t, p - 1) in places for t, p in places)
            assert turns[-1].rendered.endswith("<|end|>\n") and "".join(x.rendered for x in turns).count("<|end|>") == 1
    assert results[0] == results[1] == results[2]
