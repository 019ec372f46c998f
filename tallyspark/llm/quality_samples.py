"""Labelled texts for fitting the quality model; all invented here.

``generated`` writes weakly labelled examples of every kind by rule, so that a small or one-sided corpus still shows
the model each kind. ``INVENTED`` was written and labelled by hand, one text at a time.
"""

from __future__ import annotations

import base64
import random
import re

_NOUNS = "parser cache worker index queue timer socket router ledger buffer report widget branch schema token module filter client".split()
_ADJ = "slow stale broken shared empty large hidden local remote old new lazy partial strict".split()
_VERBS = "reads drops locks copies skips writes loads merges retries ignores flushes sorts".split()
_DO = "drop the, rename the, move the, check the, write a test for the, ask for the, put the, get rid of the, take the old, keep one".split(", ")
_TO = "at the start, for now, out of the loop, in one place, before the call, on each retry, with care, to the end, and log it, as it is".split(", ")
_PROSE = {
    "en": ["the {a} {n} {v} the {m} when the {k} is {b}", "we should not merge this before the {n} has a test for the {a} {m}", "I think it is better to return early, because the {n} {v} the {a} {m}", "what happens to the {n} if the {m} is {b} and nobody {v} it"],
    "de": ["der {n} ist nicht bereit, weil die {m} noch auf den {k} wartet", "wir haben das mit dem {n} und der {m} geprüft, aber es war nicht schnell", "ich kann den {n} vor der {m} nicht sehen"],
    "fr": ["le {n} ne garde pas la {m} quand le {k} est vide", "nous avons vu que la {m} est dans le {n} pour toutes les {k}", "il faut vérifier le {n} avec la {m} car elle se perd"],
    "es": ["el {n} no lee la {m} cuando hay un {k} en la tabla", "no me queda claro si la {m} es para el {n} o los {k}", "se debe revisar el {n} antes de la {m} y todos los {k}"],
    "ja": ["この{n}の動作が分かりにくいです", "前の{m}では処理が空のときに失敗しました", "{n}のテストを追加した方がよいと思います", "{m}から{k}を読むときに遅くなります"],
}


def _fill(rng: random.Random, form: str) -> str:
    return form.format(a=rng.choice(_ADJ), b=rng.choice(_ADJ), n=rng.choice(_NOUNS), m=rng.choice(_NOUNS), k=rng.choice(_NOUNS), v=rng.choice(_VERBS))


def _prose(rng: random.Random) -> str:
    lang = rng.choice(list(_PROSE))
    end, join = ("。", "") if lang == "ja" else (rng.choice([".", ".", ".", "!", ""]), rng.choice([" ", " ", "\n", "\n\n"]))
    text = join.join(_fill(rng, rng.choice(_PROSE[lang])) + end for _ in range(rng.randint(1, 14)))
    if rng.random() < 0.15 and lang != "ja":
        text = re.sub(r"[.!?,;]", "", text)
    if rng.random() < 0.3 and lang != "ja":
        words, width, lines, line = text.split(), rng.randint(40, 80), [], ""
        for w in words:
            if len(line) + len(w) > width:
                lines, line = [*lines, line], w
            else:
                line = f"{line} {w}".strip()
        text = "\n".join([*lines, line])
    if rng.random() < 0.15 and len(text) > 300:
        text += "\n\n" + rng.choice(["- first case\n- second case", "| a | b |\n|---|---|\n| 1 | 2 |", "```\nx = load(y)\n```"]) + "\n\n" + text[: len(text) // 2]
    return text


def _item(rng: random.Random) -> str:
    return rng.choice(
        [
            lambda: f"{rng.choice(_ADJ)} {rng.choice(_ADJ)} {rng.choice(_NOUNS)}",
            lambda: f"{rng.choice(_NOUNS)}/{rng.choice(_NOUNS)}/{rng.choice(_VERBS)}_{rng.choice(_NOUNS)}.{rng.choice(['py', 'go', 'rs', 'sql'])}",
            lambda: f"{rng.choice(_NOUNS)} {rng.choice(_NOUNS)}: {rng.choice(['use a shared helper', 'drop the fallback', 'log the id', 'move the check up', 'cover it with a test'])}{rng.choice(['', '.', ';'])}",
            lambda: f"{rng.choice(_VERBS)}{rng.choice(_NOUNS).title()} {rng.randint(0, 9)}.{rng.randint(0, 20)}",
            lambda: f"{rng.choice(_DO)} {rng.choice(_NOUNS)} {rng.choice(_TO)}",
        ]
    )()


def _list(rng: random.Random) -> str:
    items = [_item(rng) for _ in range(rng.randint(5, 40))]
    if rng.random() < 0.3:
        items = [f"{rng.choice(_DO)} {rng.choice(_NOUNS)}{rng.choice(['', ' ' + rng.choice(_TO)])}" for _ in items]
    elif rng.random() < 0.3:
        items = [rng.choice([f"{rng.choice(_VERBS)}_{rng.choice(_NOUNS)}_{rng.choice(_ADJ)}", f"{rng.choice(_VERBS)}{rng.choice(_NOUNS).title()}{rng.randint(0, 900)}"]) + rng.choice(["", f" {rng.randint(0, 9)}.{rng.randint(0, 20)}"]) for _ in items]
    style = rng.choice(["- ", "* ", "• ", "+ ", "– ", "#", "", "", "- [ ] ", ", ", ", "])
    head = rng.choice(["", "", "Touched parts\n", "Open:\n"])
    if style == ", ":
        return head + ", ".join(items)
    return head + "\n".join((f"{i + 1}{rng.choice('.)')} " if style == "#" else style) + x for i, x in enumerate(items))


def _table(rng: random.Random) -> str:
    cols, rows = rng.randint(3, 6), rng.randint(4, 25)
    cell = lambda: rng.choice([lambda: str(rng.randint(0, 999)), lambda: f"{rng.random() * 900:.2f}", lambda: rng.choice(_NOUNS), lambda: ""])()
    if rng.random() < 0.3:  # figures alone, with or without a head
        cell = lambda: rng.choice([str(rng.randint(0, 999)), f"{rng.random() * 900:.2f}", str(rng.randint(0, 9))])
    body = [[rng.choice(_NOUNS) for _ in range(cols)]] + [[cell() for _ in range(cols)] for _ in range(rows)]
    if rng.random() < 0.3:
        body = body[1:]
    style = rng.choice(["pipe", ",", ";", "\t", "gap", "html", "grid", "bare"])
    if style in ",;\t":
        return "\n".join(style.join(r) for r in body)
    if style == "pipe":
        return "\n".join("| " + " | ".join(r) + " |" for r in [body[0], ["---"] * cols, *body[1:]])
    if style == "bare":
        return "\n".join(" | ".join(r) for r in body)
    if style == "html":
        return "<table>\n" + "\n".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in body) + "\n</table>"
    width = max(len(c) for r in body for c in r) + 2
    if style == "grid":
        bar = "+" + "+".join("-" * width for _ in range(cols)) + "+"
        return "\n".join([bar, *("|" + "|".join(c.ljust(width) for c in r) + "|" for r in body), bar])
    return "\n".join("".join(c.ljust(width) for c in r).rstrip() for r in body)


def _junk(rng: random.Random) -> str:
    n = rng.randint(30, 200)
    consonants = "bcdfghjklmnpqrstvwxz"
    return rng.choice(
        [
            lambda: " ".join("".join(rng.choice(consonants) for _ in range(rng.randint(2, 11))) for _ in range(n)),
            lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 11))) for _ in range(n)),
            lambda: " ".join(str(rng.randint(0, 10 ** rng.randint(1, 12))) for _ in range(n)),
            lambda: base64.b64encode(rng.randbytes(n * 3)).decode(),
            lambda: "\n".join(base64.b64encode(rng.randbytes(48)).decode() for _ in range(n // 10)),
            lambda: "\n".join(f"{16 * i:08x}  " + " ".join(f"{rng.randrange(256):02x}" for _ in range(16)) for i in range(n // 6)),
            lambda: rng.choice(["ok", "null", "ping", "test", "lorem", "error"]).join([""] * 2) + (rng.choice([" ", ", ", "\n"]).join([rng.choice(_NOUNS)] * n)),
            lambda: "".join(rng.choice(["-", "=", "_", "#", "*", "~", "."]) * rng.randint(8, 40) + rng.choice([" ", "\n", ""]) for _ in range(n // 10)),
            lambda: "&".join(f"{rng.choice(consonants)}{rng.choice(consonants)}=%{rng.randrange(256):02X}{rng.randrange(16**6):06x}" for _ in range(n // 4)),
            lambda: "".join(rng.choice("!@#$%^&*()[]{}<>?/\\|~`+=") for _ in range(n * 3)),
            lambda: rng.choice(["a", "!", "?", "ha", "x"]) * n,
            lambda: "".join(chr(rng.choice([rng.randrange(0xC0, 0x17F), rng.randrange(0x2500, 0x25FF), 0xFFFD])) for _ in range(n * 2)),
            lambda: "".join(rng.choice("€Ÿ¢©™œ¼½¸³¤âÂÃ\ufffd  ") for _ in range(n * 3)),
        ]
    )()


def generated(each: int = 200, seed: int = 11) -> list[tuple[str, str]]:
    """``each`` examples of every structural kind and three times as many of prose: (text, kind)."""
    rng = random.Random(seed)
    makers = [("prose", _prose, 3 * each), ("list", _list, each), ("table", _table, each), ("junk", _junk, each)]
    return [(make(rng), kind) for kind, make, n in makers for _ in range(n)]


INVENTED: list[tuple[str, str]] = [
    ("I read the patch twice and could not find where the lock is released. Could you point me to it?", "prose"),
    ("LGTM, thanks for the quick fix.", "prose"),
    ("This looks fine to me but I would rather see the new flag documented before we ship it to everyone.\nPlease add a line to the readme.", "prose"),
    ("please do not merge this yet because the migration has not been run on staging and we would lose the old rows", "prose"),
    ("The failure is in `load_all`:\n\n```\nfor x in rows:\n    keep(x)\n```\n\nEvery row is kept in memory, so the job dies on large inputs. We should stream them instead and write each part as it comes.", "prose"),
    ("There are two cases to think about:\n- the file is empty\n- the file is missing\n\nIn both of them the reader returns nothing, and the caller cannot tell them apart. I would raise an error in the second case, since a missing file is never expected here.", "prose"),
    ("Der Test schlägt nur auf meinem Rechner fehl, und ich weiß noch nicht, woran das liegt. Können wir das morgen zusammen ansehen?", "prose"),
    ("Le test passe chez moi, mais il est très lent quand la base est vide. Je vais regarder pourquoi.", "prose"),
    ("No entiendo por qué la prueba falla cuando el archivo está vacío. ¿Puedes explicarlo en la descripción?", "prose"),
    ("この変更は問題ないと思いますが、テストがまだ足りません。明日もう一度確認します。", "prose"),
    ("We measured it again after the change.\n\n| run | ms |\n|---|---|\n| old | 41 |\n| new | 17 |\n\nThat is more than twice as fast, and the memory stays the same. I think we can take it, as long as nobody needs the old order of the rows.", "prose"),
    ("It works.\nIt is also much shorter than before.\nI have no further remarks.\nThanks for taking the time to write the tests.", "prose"),
    ("After the deploy we saw a short spike of errors, which\nwent away on its own after a few minutes. Nobody was\npaged. I still want to know where it came from, since\nit may come back with the next release.", "prose"),
    ("What is this for?", "prose"),
    ("Why do we need both of them here, and which one is used when the cache is cold?", "prose"),
    ("> I would not do this in the request.\n\nAgreed, moved it to the worker. The request now only writes a row and returns, and the worker picks it up within a second or two.", "prose"),
    ("Ich habe das so gelassen, wie es war, weil es an drei anderen Stellen genauso gemacht wird.", "prose"),
    ("nit: this name says what it is, not what it does", "prose"),
    ("Both of the callers already hold the lock when they get here, so taking it a second time will only work as long as it stays reentrant, which is not something that I want to rely on.", "prose"),
    ("Merci pour la relecture, c'est corrigé. J'ai aussi ajouté un test pour le cas vide.", "prose"),
    ("テストを追加しました。空のときも動きます。\n\nご確認をお願いします。", "prose"),
    ("we had this before and it was reverted see the old thread for the reasons i do not think that anything has changed since then", "prose"),
    ("- apples\n- pears\n- plums\n- cherries", "list"),
    ("1. clone the repository\n2. install the tools\n3. run the tests\n4. open a branch\n5. send the patch", "list"),
    ("Reviewers\n* mira\n* tolva\n* henk\n* suri\n* bela", "list"),
    ("src/app/main.py\nsrc/app/views.py\nsrc/lib/util.py\ntests/test_main.py\ntests/test_views.py\nREADME.md", "list"),
    ("- [x] rename the flag\n- [x] update docs\n- [ ] remove old code\n- [ ] announce it", "list"),
    ("red, green, blue, cyan, magenta, yellow, black, white, orange, purple, brown, grey, pink, teal", "list"),
    ("• cache: drop the fallback\n• queue: log the id\n• parser: cover it with a test.\n• timer: return early;\n• index: move the check up", "list"),
    ("TODO\n1) fast path\n2) slow path\n3) error path\n4) cleanup\n5) release notes", "list"),
    ("alpha build\nbeta build\nrelease candidate\nhot fix\nlong term branch\nnightly\nweekly", "list"),
    ("+ small buttons\n+ large buttons\n  + round corners\n  + sharp corners\n+ tool tips\n+ key shortcuts", "list"),
    ("parse_line 1.2\nread_block 2.0\nopen_file 0.4\nclose_file 0.9\nflush_all 3.1\nseek_to 1.1", "list"),
    ("a) keep it\nb) drop it\nc) rename it\nd) split it", "list"),
    ("lib/a.rs, lib/b.rs, lib/c.rs, lib/d.rs, lib/e.rs, bin/run.rs, bin/check.rs, bin/serve.rs", "list"),
    ("– tired lamp\n– green chair\n– old sofa\n– glass table\n– wall clock\n– door mat", "list"),
    ("name,age,city\nanna,31,oslo\nben,44,rome\ncarl,27,bonn\ndora,39,lyon", "table"),
    ("| host | cpu | mem |\n|---|---|---|\n| a1 | 12 | 40 |\n| a2 | 90 | 71 |\n| a3 | 33 | 52 |", "table"),
    ("host\tcpu\tmem\na1\t12\t40\na2\t90\t71\na3\t33\t52\na4\t5\t8", "table"),
    ("id;state;owner\n1;open;lena\n2;closed;marc\n3;open;\n4;draft;tom", "table"),
    ("name      hits   rate\nalpha     120    0.91\nbeta      7      0.10\ngamma     98     0.55\ndelta     3      0.02", "table"),
    ("<table>\n<tr><th>k</th><th>v</th></tr>\n<tr><td>a</td><td>1</td></tr>\n<tr><td>b</td><td>2</td></tr>\n</table>", "table"),
    ("+-----+-----+\n|a    |b    |\n+-----+-----+\n|1    |2    |\n|3    |4    |\n+-----+-----+", "table"),
    ("Results of the night run\nmodel | f1 | time\nsmall | 0.71 | 3\nlarge | 0.83 | 19\nhuge | 0.84 | 120", "table"),
    ("2024-01-01,10,20,30\n2024-01-02,11,19,33\n2024-01-03,9,25,31\n2024-01-04,14,22,29", "table"),
    ("p50     p90     p99\n12.1    40.8    99.0\n11.9    41.2    97.5\n12.6    39.9    101.3", "table"),
    ("xkqzt plmrw vbnzx qqwrt zxcvb mnbvc lkjhg fdsxz wrtpl kjhgf dsxzc vbnml", "junk"),
    ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "junk"),
    ("test test test test test test test test test test test test test test test test test test test", "junk"),
    ("=====================\n---------------------\n*********************\n#####################", "junk"),
    ("1839 4471 9920 1 77 38812 4 556 1029 3847 5561 209 8 771 63 5002 91 7 40 3321 88", "junk"),
    ("q83hf0Q9vJt2Zx1LmN7yR4bT6cW8dE5aS0gK3hP9uI2oV7nXjYlBzMfDrGtHwQkCsAeUiOpLqJvNxZyRbTmWcEdSaKgHfPu", "junk"),
    ("00000000  4d 5a 90 00 03 00 00 00 04 00 00 00 ff ff 00 00\n00000010  b8 00 00 00 00 00 00 00 40 00 00 00 00 00 00 00\n00000020  00 00 00 00 00 00 00 00 00 00 00 00 00 00 00 00", "junk"),
    ("!!! ??? !!! ??? @@@ ### $$$ %%% ^^^ &&& *** ((( ))) !!! ??? @@@ ###", "junk"),
    ("null\nnull\nnull\nnull\nnull\nnull\nnull\nnull\nnull\nnull\nnull\nnull", "junk"),
    ("x=%4F%2A9f3c&y=%11%FF0ab2&z=%9C%3Ed41e&w=%7B%2288aa&v=%00%1Fbc12&u=%AA%BB99ef", "junk"),
    ("� ��� �� ������ � �� ���� � ��� ���� �� ���", "junk"),
    ("hahahahahahahahahahahahahahahahahahahahahahahahahahahahahaha", "junk"),
]
