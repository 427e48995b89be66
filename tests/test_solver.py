"""Expected values of the solver and the verifier."""

import random
from collections import Counter

import pytest

from tetrad.functions import solver
from tetrad.functions.solver import solve, verify

# Analogies that hold.
TRUE = """
setzen : setzte :: lachen : lachte
lang : längste :: scharf : schärfste
sprechen : wir sprächen :: nehmen : wir nähmen
sprechen : er spräche :: nehmen : er nähme
sprechen : du sprächest :: nehmen : du nähmest
sprechen : ihr sprächet :: nehmen : ihr nähmet
sprechen : ihr aussprächet :: nehmen : ihr ausnähmet
fliehen : er floh :: schließen : er schloß
sprechen : aussprächet :: nehmen : ausnähmet
ضسمضكض : ضقسضمض :: كعسمهكعر : كعقسهمعر
ضسمضكض : ضقسضمض :: كعسمهك : كعقسهم
huzila : huzAl :: Sudi`a : SudA`
kalb : kulaib :: masjid : musaijid
yaSilu : yaSala :: yasimu : yasama
aslama : arsala :: muslimun : mursilun
aslama : arsala :: muslim : mursil
kataba : kAtib :: sakana : sAkin
ukaSSad : uktanaSSad :: uSakSad : uStanakSad
iahmod : mahmAd :: ia`abor : ma`abAr
yaqtilu : qatil :: yuqtilu : qutil
yasriqu : sariq :: yanqimu : naqim
一年，是我国社会主义 : 一年是我国 :: ，社会主义 :
科学 : 科学家 :: 政治 : 政治家
我 : 我们 :: 他 : 他们
今年 : 今天 :: 明年 : 明天
读 : 读者 :: 学 : 学者
勇 : 勇者 :: 强 : 强者
车 : 车行 :: 药 : 药行
学 : 学院 :: 医 : 医院
工程 : 工程师 :: 理发 : 理发师
kexue : kexuejia :: zhengzhi : zhengzhijia
wo : women :: ta : tamen
jinnian : jintian :: mingnian : mingtian
du : duzhe :: xue : xuezhe
AduA : AduzheA :: AxueA : AxuezheA
yong : yongzhe :: qiang : qiangzhe
che : chehang :: yao : yaohang
xue : xueyuan :: yi : yiyuan
gongcheng : gongchengshi :: lifa : lifashi
dues : indu :: nées : inné
inné : nées :: indu : dues
réaction : réactionnaire :: répression : répressionnaire
aimer : ils aimaient :: marcher : ils marchaient
pardonner : impardonnable :: décorer : imdécorable
joindre : je joins :: oindre : je oins
logique : logiciel :: ludique : ludiciel
prendrai : prendre :: viendrai : viendre
changer : tu changes :: observer : tu observes
marcher : tu marches :: démenager : tu démenages
préférer : je préfère :: vénérer : je vénère
préférer : je préfère :: révérer : je révère
préférer : je préfère :: zébrer : je zèbre
fini : infini :: exact : inexact
recevoir : j'ai reçu :: percevoir : j'ai perçu
décevoir : j'ai déçu :: percevoir : j'ai perçu
concevoir : j'ai conçu :: percevoir : j'ai perçu
食べる : 食べます :: 認める : 認めます
痛い : 痛む :: 親しい : 親しむ
あれ : これ :: あっち : こっち
乗る : 乗せる :: 寄る : 寄せる
自由 : 不自由な :: 用意 : 不用意な
飛びます : 飛ぶ :: 選びます : 選ぶ
飲む : 飲みます :: 進む : 進みます
飲みます : 飲んでみます :: 進みます : 進んでみます
冷める : 冷まる :: 決める : 決まる
新しい : 新しかった :: 嬉しい : 嬉しかった
新しい : 新しかった :: きれい : きれかった
oratorem : orator :: honorem : honor
facio : conficio :: capio : concipio
amo : amas :: oro : oras
amo : amat :: oro : orat
amo : amamus :: oro : oramus
tinggal : ketinggalan :: duduk : kedudukan
pekerja : kerja :: pelawat : lawat
kawan : mengawani :: keliling : mengelilingi
isteri : beristeri :: ladang : berladang
keras : mengeraskan :: kena : mengenakan
biorąc : bierzesz :: piorąc : pierzesz
ubezpieczony : ubezpieczeni :: obrażony : obrażeni
spiewać : spiewaczka :: łechtać : łechtaczka
wyszedłem : wyszłaS :: poszedłem : poszłaS
rozproszyć : rozpraszać :: rozmnożyć się : rozmnażać się
stworzyć : stwarzać :: mnożyć się : mnażać się
stworzyć : stwarzać :: rozmnożyć się : rozmnażać się
wyszedłeś : wyszłaś :: poszedłeś : poszłaś
zgubiony : zgubieni :: zmartwiony : zmartwieni
ṥpiewać : ṥpiewaczka :: biegać : biegaczka
wolf : wolves :: leaf : leaves
wolf : wolves :: calf : calves
bb : ab :: ba : aa
a : aa :: aaa : aaaa
b : ab :: aab : aaab
b : ba :: baa : baaa
ab : aabb :: aaabbb : aaaabbbb
ab : abab :: ababab : abababab
aab : aaaabb :: aaaaaabbb : aaaaaaaabbbb
aba : aabbaa :: aaabbbaaa : aaaabbbbaaaa
ab : aabb :: aaaaaaabbbbbbb : aaaaaaaabbbbbbbb
abc : aabbcc :: aaabbbccc : aaaabbbbcccc
a : aa :: aaaaaaa : aaaaaaaa
b : ab :: aaaaaaab : aaaaaaaab
ab : abab :: ababababababab : abababababababab
aab : aaaabb :: aaaaaaaaaaaaaabbbbbbb : aaaaaaaaaaaaaaaabbbbbbbb
aba : aabbaa :: aaaaaaabbbbbbbaaaaaaa : aaaaaaaabbbbbbbbaaaaaaaa
abc : aabbcc :: aaaaaaabbbbbbbccccccc : aaaaaaaabbbbbbbbcccccccc
""".strip("\n").splitlines()

# Analogies that do not hold.
FALSE = """
a : ab :: c : bc
abcde : edcba :: abc : cba
b : b :: ba : bb
b : ab :: aab : abaa
a : aa :: aaa : aaaaa
ab : aabb :: aaabbb : aaabbbba
ab : aabb :: aaabbb : aaabbbab
ab : aabb :: aaabbb : aaabbbaa
ab : aabb :: aaabbb : aaabbabb
ab : aabb :: aaabbb : aabbbaba
ab : aabb :: aaabbb : aabbbaab
ab : aabb :: aaabbb : abbbbaaa
ab : aabb :: aaabbb : aaababbb
ab : aabb :: aaabbb : aabbabba
ab : aabb :: aaabbb : aabbabab
ab : aabb :: aaabbb : abbbabaa
ab : aabb :: aaabbb : abbbaabb
ab : aabb :: aaabbb : abbbaaba
ab : aabb :: aaabbb : bbbbaaaa
ab : aabb :: aaabbb : aababbba
ab : aabb :: aaabbb : aababbab
ab : aabb :: aaabbb : abbabbaa
ab : aabb :: aaabbb : aabababb
ab : aabb :: aaabbb : abbababa
ab : aabb :: aaabbb : bbbabaaa
ab : aabb :: aaabbb : aabaabbb
ab : aabb :: aaabbb : abbaabba
ab : aabb :: aaabbb : abbaabab
ab : aabb :: aaabbb : bbbaabaa
ab : aabb :: aaabbb : abbaaabb
ab : aabb :: aaabbb : bbbaaaba
ab : aabb :: aaabbb : bbabbbba
ab : aabb :: aaabbb : bbabbbab
ab : aabb :: aaabbb : bababbaa
ab : aabb :: aaabbb : baaabbba
ab : abab :: ababab : ababbaab
ab : abab :: ababab : bbababaa
aab : aaaabb :: aaaaaabbb : aaabaaaababb
aba : aabbaa :: aaabbbaaa : aababbabaaaa
ab : aabb :: aaaaaaabbbbbbb : aabaaaaababbbbbb
abc : aabbcc :: aaabbbccc : aababcbbcacc
ab : aabb :: ab : abba
ab : ab :: aabb : abba
ab : abab :: abab : abbaab
abbaab : abab :: abab : ab
ab : aabb :: aabb : aababb
""".strip("\n").splitlines()

# Fixed value: an analogy that is said to hold, but whose last word has a character that no other word has.
UNBALANCED = "نضفضزض : نضضفهز :: سضنضوض : سضضنهر"

# Solutions, and words that are none.
SOLVED = """
eue : rue :: nous devons : nous drvons
tata : tàtà :: haha : hàhà
tété : tete :: héhé : hehe
tete : tété :: hehe : héhé
aaaa : à :: aaaàa : àà
決める : 決めます :: 食べる : 食べます
一年，是我国社会主义 : ，社会主义 :: 一年是我国 :
""".strip("\n").splitlines()
UNSOLVED = """
sue : rue :: nous devons : nous desons
eue : rue :: nous devons : nous devons
sus : vus :: nous devons : nous devons
""".strip("\n").splitlines()


def words(line):
    return [w.strip() for ratio in line.split(" :: ") for w in f"{ratio} ".split(" : ")]


@pytest.mark.parametrize("line", TRUE)
def test_holds(line):
    assert verify(*words(line))


@pytest.mark.parametrize("line", FALSE)
def test_does_not_hold(line):
    assert not verify(*words(line))


def test_characters_that_do_not_balance():
    """A proportion keeps characters: what is solved has the one that the other words have."""
    a, b, c, d = words(UNBALANCED)
    assert Counter(a + d) != Counter(b + c) and not verify(a, b, c, d)
    assert Counter(a + solve(a, b, c)) == Counter(b + c) and solve(a, b, c)[:-1] == d[:-1]


@pytest.mark.parametrize("line", SOLVED)
def test_solved(line):
    a, b, c, d = words(line)
    assert solve(a, b, c) == d


@pytest.mark.parametrize("line", UNSOLVED)
def test_not_solved(line):
    a, b, c, d = words(line)
    assert solve(a, b, c) != d


@pytest.mark.parametrize(
    ("a", "b", "c", "d"),
    [("aslama", "muslim", "arsala", "mursil"), ("abc", "aabbcc", "aaabbbccc", "aaaabbbbcccc"), ("aaa", "aa", "a", ""), ("aaac", "aa", "a", None), ("a" * 700, "a" * 400 + "b", "a" * 700, "a" * 400 + "b")],
)
def test_solutions(a, b, c, d):
    assert solve(a, b, c) == d


@pytest.mark.parametrize("line", TRUE)
def test_length_of_solution(line):
    a, b, c, _ = words(line)
    assert len(solve(a, b, c)) == len(b) + len(c) - len(a)


def best(a, b, c):
    """The alignment of least cost by tables over all prefixes, and the preferred of equals."""
    if b == c and not is_in(a, b):
        return None
    cost = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            for k in range(len(c) + 1):
                ways = [cost[s] + n for s, _, n in solver._columns(a, b, c, (i, j, k)) if s in cost]
                if not (i or j or k) or ways:
                    cost[i, j, k] = min(ways, default=0)
    now, out = (len(a), len(b), len(c)), ""
    if now not in cost:
        return None
    while any(now):
        now, x = next((s, x) for s, x, n in solver._columns(a, b, c, now) if s in cost and cost[s] + n == cost[now])
        out = x + out
    return out


def is_in(a, b):
    rest = iter(b)
    return all(x in rest for x in a)


def test_search_finds_what_tables_find():
    r = random.Random(4)
    solved = 0
    for n in range(4000):
        word = lambda most: "".join(r.choice("abcd"[: 2 + n % 3]) for _ in range(r.randint(0, most)))
        a, b, c = word(5), word(8), word(8)
        assert solver._reading(a, b, c) == best(a, b, c), (a, b, c)
        solved += best(a, b, c) is not None
    assert solved > 1000


def test_long_words():
    r = random.Random(5)
    stem = "".join(r.choice("abcdefgh") for _ in range(300))
    other = "".join(r.choice("ijklmnop") for _ in range(300))
    assert solve(stem + "er", "ge" + stem + "t", other + "er") == "ge" + other + "t"
