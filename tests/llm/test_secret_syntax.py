"""Names and values in the syntax of many languages, held against generated source."""

import random

import pytest

from braidwork.llm import secrets

KEY = "Zk39fjA0qLmN7xPw"


def literals(text):
    return [text[s:e] for s, k, e in secrets.scan(text)[1] if k == 3]


@pytest.mark.parametrize(
    "text",
    [
        'const char *private_key = "{}";', 'char private_key[] = "{}";', 'std::string privateKey("{}");', 'std::string privateKey{"{}"};', '#define SIGNING_KEY "{}"', '# define SIGNING_KEY "{}"', 'client.setSigningKey("{}");', 'config.set_private_key("{}")', "builder.withPrivateKey('{}')",
        "private_key: |\n  {}\nother: x", "a:\n  private_key: >-\n    {}\n\n  b: c", 'private_key =\n    "{}"', 'private_key = \\\n    "{}"', 'private_key = debug ? "{}" : other;', 'private_key = debug ? "" : "{}";', 'private_key = "{}" if env == "prod" else None', 'private_key = x == 1 ? "{}" : y',
        'user, private_key = ("bob", "{}")', 'private_key, user = "{}", "bob"', 'X = "{}"\nprivate_key = f"{X}"', "const x = '{}';\nconst privateKey = `${x}`;", 'private_key = "".join(["{}"])', "<private_key><![CDATA[{}]]></private_key>", "run --private-key {}", "run -v --private-key '{}' now",
        "const std::string &signing_key = \"{}\";", "QString signingKey('{}')", "private_key = " + "f(" * 40 + '"{}"' + ")" * 40, "".join(f"a{k} = a{k + 1}\n" for k in range(300)) + 'a300 = "{}"\nprivate_key = a0', 'dbPassphrase = "{}"', 'SIGNINGKEY = "{}"', 'mysigningkey = "{}"', "access_keys: {}",
    ],
)
def test_syntaxes(text):
    assert literals(text.replace("{}", KEY)) == [KEY]


def test_values_of_several_parts():
    assert literals(f'private_key = "".join(["Zk39fjA0", "qLmN7xPw2RtY"])') == ["Zk39fjA0", "qLmN7xPw2RtY"]
    assert literals("private_key: |\n  Zk39fjA0qLmN\n  7xPw2RtYqqqq\nnext: 1") == ["Zk39fjA0qLmN", "7xPw2RtYqqqq"]
    assert literals('part = "fjA0qLmN7xPw"\nsigning_key = f"Zk39{part}RtY"') == ["fjA0qLmN7xPw", "Zk39", "RtY"]


@pytest.mark.parametrize(
    "text",
    [
        'author = "JohnSmith1987Qx"', 'tokenizer = "bert-base-Uncased-v2"', 'token_url = "https://example.org/A1b2C3d4"', 'auth_header_name = "X-Auth-Header-99"', 'secretary = "JohnSmith1987Qx"', 'basalt = "JohnSmith1987Qx"', 'return private_key("A1b2C3d4E5f6G7")', "f(a, b, c=5)",
        'user, name = ("A1b2C3d4E5f6G7H8", "B1b2C3d4E5f6G7H8")', "private_key = cond ? other : another", "private_key: |\nnext: x", "<private_key><![CDATA[]]></private_key>", "--private-key", "#define PRIVATE_KEY\n", 'private_key = "".join(parts)',
    ],
)
def test_no_secrets(text):
    assert literals(text) == []


NAMES = {"private_key": True, "signingKey": True, "API_KEY": True, "author": False, "colour": False, "tokenizer": False, "secret_name": False, "dbCredential": True}
#: Syntax -> (a plain assignment, a constant and its use, words around).
SYNTAXES = {
    "python": ('{n} = "{v}"', '{c} = "{v}"\n{n} = {c}'),
    "c": ('const char *{n} = "{v}";', 'static char {c}[] = "{v}";\nchar *{n} = {c};'),
    "go": ('var {n} string = "{v}"', 'const {c} = "{v}"\nvar {n} string = {c}'),
    "javascript": ("const {n} = '{v}';", "let {c} = '{v}';\nlet {n} = {c};"),
    "yaml": ("{n}: {v}", "{n}: |\n  {v}"),
    "java": ('String {n} = "{v}";', 'conf.set("{n}", "{v}");'),
}


@pytest.mark.parametrize("syntax", SYNTAXES)
def test_generated_source(syntax):
    """What was put in under a sensitive name comes out, and nothing else does."""
    r = random.Random(syntax)
    for _ in range(60):
        lines, wanted = [], []
        for k in range(r.randint(1, 12)):
            name = r.choice([*NAMES])
            value = "".join(r.choice(x) for _ in range(5) for x in ("ABCDEFGHJKLMNPQRSTUVWXYZ", "abcdefghijkmnpqrstuvwxyz", "23456789", "bcdfghjkmnp"))
            lines.append(r.choice(SYNTAXES[syntax]).format(n=name, v=value, c=f"part{'abcdefghijklm'[k]}"))
            wanted += [value] * NAMES[name]
        text = "\n".join(lines) + "\n"
        found = [text[s:e] for s, _, e in secrets.scan(text)[1]]
        assert [w for w in wanted if not any(w in x for x in found)] == [] and len(found) >= len(wanted)
        assert all(any(w in x for w in wanted) for x in found)


def test_long_chains_lose_nothing(monkeypatch):
    text = f'a = "{KEY}"\n' + "".join(f"signing_key = signing_key + x{k}\n" for k in range(50)) + f'private_key = a\nb = "{KEY}9"\nprivate_key = b\n'
    wanted = literals(text)
    monkeypatch.setattr(secrets, "VISITS", 10)
    assert literals(text) == wanted == [KEY, KEY + "9"]


def test_no_number_of_definitions_changes_what_is_found(monkeypatch):
    """A literal in pieces is one, in texts of few definitions and of many."""
    pieces = [KEY[k : k + 4] for k in range(0, len(KEY), 4)]
    texts = ["".join(f'part_{k} = "{x}"\n' for k, x in enumerate(pieces)) + "private_key = " + " + ".join(f"part_{k}" for k in range(len(pieces))) + "\n"]
    r = random.Random(8)
    for _ in range(400):
        names = ["a", "b", "token", "signing_key", "c.token"][: r.randint(1, 5)]
        values = lambda: r.choice([f'"{r.choice([*pieces, "xx", "", " ", "your_", "<", ">", "${", "}", KEY])}"', *names])
        texts.append("".join(f"{r.choice(names)} = {' + '.join(values() for _ in range(r.randint(1, 3)))}\n" for _ in range(r.randint(1, 14))))
    wanted = [secrets.literal_spans(x) for x in texts]
    assert sum(map(bool, wanted)) > 50
    monkeypatch.setattr(secrets, "VISITS", -1)
    assert [secrets.literal_spans(x) for x in texts] == wanted


def test_long_texts_take_linear_time():
    import time

    for text in ("a, " * 100_000, "a, b = " * 30_000, "x = a ? " * 30_000, 'x = "a" if ' * 20_000, "key: |\n" * 20_000, "f(" * 100_000, "--key " * 50_000, 'T n("x") ' * 20_000, '"".join([' * 20_000, "private_key=g(" + "f(" * 100_000):
        before = time.process_time()
        secrets.scan(text)
        assert time.process_time() - before < 20, text[:20]
