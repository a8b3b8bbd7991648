"""Word lists of the two normalisation generations, as data."""

from __future__ import annotations

from functools import lru_cache
from unicodedata import normalize

# Groups of spellings, the canonical one first; of two groups with one spelling the first counts.
_GROUPS = """
road rd | street st | avenue ave av | boulevard blvd | lane ln | drive dr | court ct | place pl | circle cir
highway hwy | parkway pkwy pky | terrace ter terr | apartment apt | suite ste | building bldg | floor fl flr
north n | south s | east e | west w | northeast ne | northwest nw | southeast se | southwest sw
mount mt | fort ft | saint st | center ctr | square sq
rue | avenue av | boulevard blvd bd | allee all | impasse imp | chemin ch | passage pass | voie | route rte | place pl | quai
corporation corp | company co | incorporated inc | limited ltd | international intl | manufacturing mfg
association assn assoc | department dept | national natl | general gen | management mgmt | technology tech
technologies tech | industries ind | solutions sol soln | systems sys | enterprises ent | foundation fdn found
university univ | institute inst | hospital hosp | private pvt | limited ltd
"""

# Words that carry no identity, after expansion.
_STOPWORDS = """
inc llc corp corporation ltd limited pvt private co company services service group enterprises enterprise
holdings holding llp pllc lp plc
sarl sas sasu eurl sci sa snc gie
gmbh ag ohg kg
and the of in at on for to a an
des du de la le les et au aux
road rd street st avenue ave lane ln drive dr floor fl unit suite ste near opp behind block sector plot no
building bldg tower court ct place pl circle cir highway hwy parkway pkwy terrace ter
rue boulevard blvd allee all impasse imp chemin ch passage pass voie route rte quai cedex bp
nagar marg path gali
"""

# Legal suffixes of the canonical (second) generation.
_SUFFIXES = """
private limited pvt ltd llp opc proprietorship
inc incorporated corp corporation llc co company enterprises enterprise services service holdings holding
group industries industry international intl plc lp trust foundation solutions associates consultants
sarl sas sasu eurl sci sa snc gmbh bv nv ets cie cabinet ste societe
"""

# Abbreviations of the second generation; a later entry overrides an earlier one.
_EXPANSIONS = """
st street, str street, rd road, dr drive, ave avenue, blvd boulevard, ln lane, ct court, pl place, hwy highway,
ste suite, apt apartment, fl floor, bldg building, pk park, pkwy parkway, cir circle, ter terrace, way way,
sq square, cl close, cres crescent, aly alley, row row, plz plaza, xing crossing,
n north, s south, e east, w west, ne northeast, nw northwest, se southeast, sw southwest,
r rue, av avenue, bd boulevard, all allee, imp impasse, che chemin, pl place, pas passage, rte route, crs cours,
res residence, bat batiment, esc escalier, etg etage, cedex cedex, bp bp,
mgmt management, tech technology, technologies technology, mfg manufacturing, dist distribution,
eng engineering, engr engineering, assoc associates, soln solutions, solns solutions, sys systems,
system systems, dev development, comm communications, med medical, ctr center, centre center, hlth health,
pharma pharmaceuticals, fin financial, serv services, svcs services, intl international, natl national,
global global, mktg marketing, auto automotive,
ap andhra pradesh, ar arunachal pradesh, as assam, br bihar, cg chhattisgarh, ga goa, gj gujarat, hr haryana,
hp himachal pradesh, jh jharkhand, ka karnataka, kl kerala, mp madhya pradesh, mh maharashtra, mn manipur,
ml meghalaya, mz mizoram, nl nagaland, od odisha, pb punjab, rj rajasthan, sk sikkim, tn tamil nadu,
ts telangana, tg telangana, tr tripura, up uttar pradesh, uk uttarakhand, ua uttarakhand, wb west bengal,
dl delhi, jk jammu and kashmir, la ladakh, py puducherry, ch chandigarh,
al alabama, ak alaska, az arizona, ar arkansas, ca california, co colorado, ct connecticut, de delaware,
fl florida, ga georgia, hi hawaii, id idaho, il illinois, in indiana, ia iowa, ks kansas, ky kentucky,
la louisiana, me maine, md maryland, ma massachusetts, mi michigan, mn minnesota, ms mississippi, mo missouri,
mt montana, ne nebraska, nv nevada, nh new hampshire, nj new jersey, nm new mexico, ny new york,
nc north carolina, nd north dakota, oh ohio, ok oklahoma, or oregon, pa pennsylvania, ri rhode island,
sc south carolina, sd south dakota, tn tennessee, tx texas, ut utah, vt vermont, va virginia, wa washington,
wv west virginia, wi wisconsin, wy wyoming, dc district of columbia
"""

# The legacy stoplist adds directions and drops the address types of France and India.
_LEGACY_STOPWORDS = """
inc llc corp corporation ltd limited pvt private co company services service group enterprises enterprise
holdings holding llp and the of in at on for to a an road rd street st avenue ave lane ln drive dr
floor fl unit suite ste near opp behind block sector plot no building bldg tower city state
rue boulevard blvd allee des du de la le east west north south
"""


def _first_wins(groups: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for group in groups.replace("\n", "|").split("|"):
        words = group.split()
        for w in words:
            out.setdefault(w, words[0])
    return out


ABBREVIATIONS = _first_wins(_GROUPS)
STOPWORDS = sorted(set(_STOPWORDS.split()))
SUFFIXES = sorted(set(_SUFFIXES.split()))
EXPANSIONS = dict(entry.split(maxsplit=1) for entry in _EXPANSIONS.replace("\n", " ").strip().split(","))
LEGACY_STOPWORDS = sorted(set(_LEGACY_STOPWORDS.split()))

# Latin letters that have no canonical decomposition.
SINGLE = {"Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ł": "L", "ł": "l", "Ħ": "H", "ħ": "h", "ı": "i"}
DOUBLE = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th"}


@lru_cache(maxsize=1)
def latin() -> tuple[str, str]:
    """Accented Latin letters and their plain ones, by canonical decomposition."""
    pairs = dict(SINGLE)
    for code in range(0xC0, 0x250):
        plain = normalize("NFD", chr(code))[0]
        if plain.isascii() and plain.isalpha():
            pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())
