"""A small scorer in plain Python to compare the engine with. It takes nothing from the engine: its values are its own."""

import re

# Fixed values, written out here as well: a wrong one in the engine shows.
STOP = set(
    """a an and are as at be been but by can did do does for from had has have how i in into is it its just like more new not of on or our out over should so
    some such than that the their them then there these they this to up use used using was we were what when which while who will with would you your also
    added fix fixed fixes update updated updates change changes changed name version private public main module modules scripts type types author engines
    description dependencies devdependencies peerdependencies license""".split()
)
ENDINGS = "ing ies ed es s".split()
CODE = set("js jsx ts tsx py go rs c h cpp hpp java kt kts svelte vue json yaml yml md css html xml sh toml sql rb php dart gradle cfg ini env proto".split())
PRODUCTS = set("node.js vue.js react.js next.js nuxt.js d3.js three.js express.js socket.io chart.js vite.js llama.cpp".split())
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve".split()
BANNED = ("next steps", "you should", "todo:", "as an ai")
LOCKS = set(
    """license license.md license.txt notice package-lock.json yarn.lock bun.lock bun.lockb pnpm-lock.yaml cargo.lock go.sum poetry.lock uv.lock gemfile.lock
    composer.lock""".split()
)
BUILT = set("dist build node_modules vendor .venv target".split())
SPARSE = 5
W = re.compile("[a-z0-9_]+")
FILE = re.compile(r"\b[\w][\w/-]*\.([A-Za-z]{1,10})\b")
CLAIM = re.compile(rf"\b(\d{{1,3}}|{'|'.join(NUMBERS)})\s+(?:active\s+|git\s+)*(?:repos?|repositories?|projects?)\b", re.I)
MODEL = re.compile(
    r"\b(gpt(?:[- ]?\d[\w.]*)?|chatgpt|openai|anthropic|claude|gemini|bard|grok|mistral|deepseek|qwen(?:\d[\w.]*)?|gemma\d*|cohere|llama(?!\.?cpp))\b", re.I
)
# End of the fixed values.


def words(t):
    return W.findall((t or "").lower())


def stem(w):
    if len(w) > 4:
        for s in ENDINGS:
            if w.endswith(s):
                return w[: -len(s)]
    return w


def tokens(t):
    return {stem(w) for w in words(t) if len(w) >= 3 and w not in STOP}


def norm(r):
    return r.strip().lower().rsplit("/", 1)[-1]


def low(name):
    *folders, base = name.lower().split("/")
    return base in LOCKS or any(f in BUILT for f in folders) or base.endswith((".min.js", ".min.css", ".lock"))


def sections(digest):
    out, summary, state = [], [], None  # state: [kind, name, lines]

    def close(next_is_section):
        if state and state[0] == "section" and state[1]:
            out.append((state[1], "\n".join(state[2]).strip()))
        elif state and state[0] == "orphan" and state[2] and next_is_section:
            out.append(("", "\n".join(state[2]).strip()))

    for line in digest.splitlines():
        if line.startswith("### "):
            close(True)
            state = ["section", line[4:].strip(), []]
        elif line.startswith("## "):
            close(False)
            title = line[3:].strip().lower()
            state = [{"summary": "summary", "per-repo activity": "orphan"}.get(title), "", []]
        elif state and state[0] == "summary":
            summary.append(line)
        elif state and (state[0] == "section" or state[0] == "orphan" and line.strip()):
            state[2].append(line)
    close(True)
    return "\n".join(summary).strip(), out


def files(t):
    return [m[0].lower().rsplit("/", 1)[-1] for m in FILE.finditer(t) if m[1].lower() in CODE]


def grams(ws, n):
    return [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)]


def score(digest, activity, truncated=False, previous=None):
    """activity: list of (repo, commits)."""
    summary, secs = sections(digest)
    patches = sum(len(c) for _, c in activity) <= SPARSE

    def shown(c):
        out = [c.get("message") or ""]
        for f in c.get("files") or []:
            if f.get("filename") and not low(f["filename"]):
                out += [f["filename"], *([f.get("patch") or ""] if patches else [])]
        return out

    firsts = {}
    for r, cs in activity:
        firsts.setdefault(norm(r), (r, cs))
    pool = {r: tokens(r).union(*[tokens(t) for c in cs for t in shown(c)]) for r, cs in activity}
    surface = {r: set().union(*[words(t) for c in cs for t in shown(c)]) for r, cs in activity}
    headers = [norm(n) for n, _ in secs]
    told = len(summary.split()) >= 10 and len(tokens(summary) & set().union(*pool.values())) >= 2
    f = (told + ("## Per-Repo Activity" in digest) + (sum(h in firsts for h in headers) / len(headers) if headers else 0)) / 3
    cov = dict.fromkeys(firsts, 0.0)
    gro = dict.fromkeys(firsts, 0.0)
    for name, body in secs:
        n = norm(name)
        if n not in firsts:
            continue
        r, cs = firsts[n]
        own = tokens(body)
        ov = len(own & pool[r])
        if len(own) >= 3 and ov >= 2:
            cov[n] = max(cov[n], min(1.0, ov / max(2, min(4, len(own) * 3 // 4))))
        best, best_ov = 0.0, 0
        for ct in [set().union(*[tokens(t) for t in shown(c)]) for c in cs] or [tokens(r)]:
            k = len(own & (ct | tokens(r)))
            if (h := min(1.0, k / max(2, min(5, len(ct))))) > best:
                best, best_ov = h, k
        gro[n] = max(gro[n], best * (0.5 if len(own) >= 6 and best_ov > 0.6 * len(own) else 1))
    c = sum(cov.values()) / len(cov) if cov else 1.0
    g = sum(gro.values()) / len(gro) if gro else 0.0
    prose = [summary, *[b for _, b in secs]]
    real = {x.get("filename").strip().lower().rsplit("/", 1)[-1] for _, cs in activity for k in cs for x in k.get("files") or [] if x.get("filename")}
    real |= {m for _, cs in activity for k in cs for m in files(k.get("message") or "")}
    everything = set().union(*surface.values(), *[words(r) for r, _ in activity])
    models = {m[0] for t in prose for m in MODEL.finditer(t)}
    models = {m for m in models if re.sub("[^a-z0-9]", "", m.lower()) not in everything and words(m)[0] not in everything}
    claims = [NUMBERS.index(x) if (x := m[1].lower()) in NUMBERS else int(x) for t in prose for m in CLAIM.finditer(t)]
    names = [n for n, _ in secs]
    p = 0.5 * sum(b in digest.lower() for b in BANNED)
    p += min(0.5, 0.3 * sum(m not in PRODUCTS and m not in real for t in prose for m in files(t)))
    p += min(0.5, 0.3 * len(models)) + min(0.5, 0.3 * sum(k != len(activity) for k in claims))
    p += 0.5 * (len(set(names)) < len(names)) + min(0.75, 0.35 * sum(h not in firsts for h in headers))
    sets = [tokens(b) for _, b in secs]
    near = [1 for i, a in enumerate(sets) for b in sets[i + 1 :] if min(len(a), len(b)) >= 6 and len(a & b) / len(a | b) > 0.6]
    p += 0.3 * bool(near)
    runs = set(grams(words(summary), 10))
    for name, body in secs:
        run = next((x for x in grams(words(body), 10) if x in runs), None)
        if run:
            content = [w for w in run.split() if len(w) >= 3 and w not in STOP]
            own = firsts.get(norm(name))
            if not (own and content and all(w in surface[own[0]] for w in content)):
                p += 0.3
                break
    p += 0.4 * any(len(w := words(t)) >= 12 and len(set(grams(w, 3))) / len(grams(w, 3)) < 0.5 for t in prose)
    p += 0.3 * bool(previous and set(grams(words(digest), 10)) & set(grams(words(previous), 10)))
    p = min(1.0, min(1.0, p) + 0.5 * truncated)
    return f, c, g, p, max(0.0, 0.30 * f + 0.45 * c + 0.25 * g - p)
