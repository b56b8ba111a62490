"""Whether two spellings mean the same person, organisation or car model: token alignment by longest-common-subsequence ratio."""

from __future__ import annotations

from collections import Counter

from .similar import lcs_ratio, memo, plain, sounded, typing_distance

LEAST_RATIO = 0.74  # of two tokens that one of them mistypes
LONG = 12  # words beyond which shared words are taken out before the rest is aligned

# Forms of address and articles that are no part of a name.
TITLES = frozenset("mr mrs ms miss dr sr sra srta shri smt prof herr frau mme mlle m/s messrs the jr".split())
# Words for the legal form of an organisation, each with its full word.
LEGAL = {"ltd": "limited", "limited": "limited", "pvt": "private", "private": "private", "p": "private", "corp": "corporation", "corporation": "corporation", "inc": "incorporated", "incorporated": "incorporated", "co": "company", "company": "company", "sons": "sons", "and": "and", "enterprises": "enterprises", "ent": "enterprises", "enterprise": "enterprises", "entp": "enterprises"}
FORMS = frozenset(LEGAL.values())
MARKS = FORMS - {"and"}
# Short forms of first names, each with the names it may stand for.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander alejandro alejandra alexandra", "andy": "andrew", "drew": "andrew", "tony": "anthony antonio", "ben": "benjamin", "benny": "benjamin",
    "chris": "christopher christine", "kit": "christopher", "charlie": "charles", "chuck": "charles", "debbie": "deborah", "deb": "deborah", "dan": "daniel", "danny": "daniel", "dave": "david",
    "ed": "edward eduardo", "eddie": "edward eduardo", "ned": "edward", "ted": "edward theodore", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth elisabeth", "eliza": "elizabeth", "paco": "francisco", "pancho": "francisco", "fran": "francisco frances", "fred": "frederick friedrich", "freddie": "frederick", "gabi": "gabriela", "gaby": "gabriela",
    "greg": "gregory", "lupe": "guadalupe", "lupita": "guadalupe", "jim": "james", "jimmy": "james", "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "hannes": "johannes", "hans": "johannes", "john": "jonathan", "jon": "jonathan", "joe": "joseph", "joey": "joseph", "pepe": "jose", "josie": "josephine", "jo": "josephine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kathi": "katharina", "larry": "lawrence", "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "greta": "margaret",
    "marge": "margaret", "matt": "matthew", "max": "maximilian", "mike": "michael", "mick": "michael", "mickey": "michael", "nick": "nicholas nicolo", "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "phil": "philip", "pip": "philip", "becky": "rebecca", "becca": "rebecca", "bob": "robert roberto", "rob": "robert", "bert": "robert", "bobby": "robert", "dick": "richard", "rick": "richard", "sam": "samuel samantha", "sammy": "samuel", "bas": "sebastian", "seb": "sebastian", "bastian": "sebastian", "steve": "stephen steven",
    "steph": "stephanie", "sue": "susan", "susie": "susan", "theo": "theodore", "tom": "thomas tomas", "tommy": "thomas", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "bill": "william", "will": "william", "billy": "william", "willy": "william wilhelm", "liam": "william", "izzy": "isabella", "bella": "isabella", "isa": "isabella", "chuy": "jesus", "nacho": "ignacio", "quique": "enrique", "lola": "dolores", "mina": "wilhelmina", "willa": "wilhelmina", "sandy": "alexander alexandra sandra", "sasha": "alexander alexandra", "ray": "raymond", "patt": "patricia", "ron": "ronald", "gus": "augustus", "kathe": "katherine", "lars": "lawrence", "fredo": "alfredo", "val": "valentina valerie", "caro": "carolina", "lena": "helena magdalena", "nina": "antonina", "toni": "anthony antonio", "robbie": "robert",
}


@memo(200_000)
def tokens(name: str) -> tuple[str, ...]:
    """The name's words without titles, legal forms written in full."""
    text = name.replace("M/s", " ").replace("m/s", " ").replace("M/S", " ").replace("'", "").replace("’", "")
    words = plain(text.replace("&", " and ")).split()
    out = [w for w in words if w not in TITLES] or words
    org = any(LEGAL.get(w) in FORMS - {"private", "and"} for w in out[1:])
    return tuple(LEGAL.get(w, w) if org else w for w in out)


@memo(200_000)
def _initials(w: str) -> frozenset[str]:
    """Letters that may stand for a first name: its own, and those of its full or short forms."""
    near = {w} | {x for x in (*NICKNAMES, *FULL) if x[0] == w[0] and len(w) > 3 and _typed(x, w) >= 0.85}
    forms = near | {f for x in near for f in NICKNAMES.get(x, "").split()} | {n for x in near for n in FULL.get(x, ())}
    return frozenset(f[0] for f in forms) | frozenset(sounded(f)[0] for f in forms)


def _digits(s: str) -> bool:
    return any(ch.isdigit() for ch in s)


@memo(500_000)
def _word(w: str) -> tuple[int, str, int, bool, tuple[str, ...]]:
    """(set of letters as bits, the word as it sounds, its set of letters, whether it has a digit, full names it may be short for)."""
    s = sounded(w)
    full: tuple[str, ...] = ()
    if 2 <= len(w) <= 8:
        nicks = [n for n in BY_LETTER.get(w[0], ()) if n == w or (abs(len(n) - len(w)) <= 1 and (sounded(n) == s or (len(n) >= 4 and lcs_ratio(n, w) >= 0.85)))]
        full = tuple(dict.fromkeys(f for n in nicks for f in NICKNAMES[n].split()))
    return _letters(w), s, _letters(s), any(ch.isdigit() for ch in w), full


def _letters(w: str) -> int:
    bits = 0
    for ch in w:
        bits |= 1 << (ord(ch) & 63)
    return bits


def _may_reach(a: str, ma: int, b: str, mb: int, least: float) -> bool:
    """False where letters that the other word lacks already keep the common subsequence too short."""
    la, lb = len(a), len(b)
    both = min(la - (ma & ~mb).bit_count(), lb - (mb & ~ma).bit_count())
    return 2 * both >= least * (la + lb)


def _typed(a: str, b: str, least: float = 0.0) -> float:
    """Common-subsequence ratio of two words as written or as they sound; 0 where it cannot reach `least`."""
    if a == b:
        return 1.0
    ma, sa, na, _, _ = _word(a)
    mb, sb, nb, _, _ = _word(b)
    if sa == sb:
        return 0.98
    r = lcs_ratio(a, b) if _may_reach(a, ma, b, mb, least) else 0.0
    return max(r, lcs_ratio(sa, sb) - 0.02 if _may_reach(sa, na, sb, nb, least + 0.02) else 0.0)


FULL: dict[str, list[str]] = {}
for _nick, _names in NICKNAMES.items():
    for _name in _names.split():
        FULL.setdefault(_name, []).append(_nick)


BY_LETTER: dict[str, list[str]] = {}
for _nick in NICKNAMES:
    BY_LETTER.setdefault(_nick[0], []).append(_nick)


def _alias(a: str, b: str) -> bool:
    """Short form and full name, either of them with one typing error, or two short forms of one name."""
    fa, fb = _word(a)[4], _word(b)[4]
    if not fa and not fb:
        return False
    if any(f == b or (abs(len(f) - len(b)) <= 2 and _typed(f, b, 0.85) >= 0.85) for f in fa):
        return True
    if any(f == a or (abs(len(f) - len(a)) <= 2 and _typed(f, a, 0.85) >= 0.85) for f in fb):
        return True
    return a in NICKNAMES and b in NICKNAMES and bool(set(fa) & set(fb))


def _pair(a: str, b: str) -> float:
    """Similarity of two words of a name: equality, nickname, initial, cut-short word, or typing error."""
    if a == b:
        return 1.0
    if _word(a)[3] or _word(b)[3]:
        return 0.0
    if len(a) == 1 or len(b) == 1:
        return 0.9 if a[0] == b[0] or sounded(a)[0] == sounded(b)[0] else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) <= 8 and _alias(a, b):
        return 0.97
    if len(short) >= 3 and long.startswith(short):
        return 0.93
    n = len(short)
    least = LEAST_RATIO if n >= 5 else 0.72 if n == 4 else 0.66
    r = _typed(a, b, least)
    return r if r >= least else 0.0


def _align(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[list[tuple[str, str, float]], list[str], list[str]]:
    scored = sorted(((_pair(x, y), -abs(i - j), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    ua, ub, got = set(range(len(a))), set(range(len(b))), []
    for s, _, i, j in scored:
        if s > 0 and i in ua and j in ub:
            ua.discard(i)
            ub.discard(j)
            got.append((a[i], b[j], s))
    return got, [a[i] for i in ua], [b[j] for j in ub]


def _unshared(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Both without the words they share, each as often as it is shared."""
    both = Counter(a) & Counter(b)
    out = []
    for ws in (a, b):
        left, rest = both.copy(), []
        for w in ws:
            if left[w] > 0:
                left[w] -= 1
            else:
                rest.append(w)
        out.append(tuple(rest))
    return out[0], out[1]


def same_name(x: str, y: str) -> bool:
    """Whether two names of one place and day mean the same person or organisation. Of names of over LONG words only the words they do not share are aligned."""
    a, b = tokens(x), tokens(y)
    if not a or not b:
        return False
    if max(len(a), len(b)) > LONG:
        ra, rb = _unshared(a, b)
        if not ra and not rb:
            return True
        if abs(len(a) - len(b)) > 2:
            return False
        kept = min(len(a) - len(ra), 2)  # shared words that stand for all of them
        shared = [w for w in dict.fromkeys(a) if w in set(b)][:kept]
        a, b = (*shared, *ra), (*shared, *rb)
    if not MARKS.isdisjoint(a) or not MARKS.isdisjoint(b):
        return _same_org(a, b)
    if len(a) == 1 or len(b) == 1:
        ja, jb = "".join(a), "".join(b)
        return min(len(ja), len(jb)) >= 6 and max(lcs_ratio(ja, jb), lcs_ratio("".join(sorted(a)), "".join(sorted(b)))) >= 0.88
    fa, fb = [w for w in a if len(w) > 1], [w for w in b if len(w) > 1]
    if not fa or not fb:
        return False
    if len(fa) >= 2 and len(fb) >= 2:
        few, many = (fa, fb) if len(fa) <= len(fb) else (fb, fa)
        for w in few:  # every word of the shorter name needs a counterpart
            if not any(_pair(w, x) for x in many):
                return False
        got, ra, rb = _align(tuple(fa), tuple(fb))
        if len(got) < 2 or (ra and rb) or len(ra) + len(rb) > 2:
            return False
        scores = [s for _, _, s in got]
        return max(scores) >= 0.78
    # one of them has a single full word and initials
    if len(fa) > 1:
        a, b, fa, fb = b, a, fb, fa
    own = [w for w in a if len(w) == 1]
    best = max(fb, key=lambda w: _pair(fa[0], w))
    if _pair(fa[0], best) < LEAST_RATIO or not own:
        return False
    others = [w for w in fb if w is not best] or [w for w in b if len(w) == 1]
    return any(i in _initials(w) for i in own for w in others)


def _same_org(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    fa, fb = [w for w in a if w not in FORMS], [w for w in b if w not in FORMS]
    la, lb = {w for w in a if w in FORMS} - {"and"}, {w for w in b if w in FORMS} - {"and"}
    if len(fa) != len(fb):
        return lcs_ratio("".join(a), "".join(b)) >= 0.93
    got, ra, rb = _align(tuple(fa), tuple(fb))
    if ra or rb or not got:
        return False
    if not (la <= lb or lb <= la or la & lb):
        return False
    return max(s for _, _, s in got) >= 0.8


def model_numbers(x: str) -> str:
    """The digits of a model's name in order of size; spellings of one model have the same."""
    return "".join(sorted(ch for w in tokens(x) for ch in w if ch.isdigit()))


def same_model(x: str, y: str) -> bool:
    """Whether two spellings mean the same car model: every word has its counterpart, numbers and single letters are equal."""
    a, b = tokens(x), tokens(y)
    if not a or not b:
        return False
    ja, jb = "".join(a), "".join(b)
    if ja == jb:
        return True
    if [w for w in sorted(a) if _digits(w)] != [w for w in sorted(b) if _digits(w)]:
        return False
    if len(a) != len(b):
        return min(len(ja), len(jb)) >= 6 and abs(len(ja) - len(jb)) <= 1 and lcs_ratio(ja, jb) >= 0.9
    if sorted(w for w in a if len(w) <= 2) != sorted(w for w in b if len(w) <= 2):
        return False
    left = [w for w in b if len(w) > 2 and not _digits(w)]
    for w in (w for w in a if len(w) > 2 and not _digits(w)):
        near = [(typing_distance(w, x, 2.0), x) for x in left if _same_word(w, x, len(a) > 1)]
        if not near:
            return False
        left.remove(min(near)[1])
    return not left


def _same_word(a: str, b: str, part: bool) -> bool:
    """One typing error apart, or alike in sound, or (beside other words) one cut short."""
    if a == b or sounded(a) == sounded(b) or typing_distance(a, b, 1.0) <= 1.0:
        return True
    short, long = sorted((a, b), key=len)
    return part and len(short) >= 3 and long.startswith(short)
