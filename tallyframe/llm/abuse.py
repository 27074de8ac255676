"""Abusive, hateful and sexual content (problem 10).

A weighted grammar of finite-state patterns over clauses. Texts are brought to plain words
first: hidden characters, widths, accents, stretched and spelled-out letters, digits and masks
in place of letters are undone. Word classes (insults, groups, threats, bodies, addressees) are
composed into clause patterns with weights; transducers for negation, rules of conduct, reported
speech and trade terms rewrite or discount what they match before the clauses are scored, so
that a word alone decides nothing where its neighbours make it harmless.

A document's score is the weight of its clauses, best pattern a clause and kind; from
``THRESHOLD`` on it is a case. A pattern runs only on clauses that hold a word of every part it
cannot match without; these parts are read off the compiled patterns, so nothing is lost, and clean
text costs little more than its tokenisation. Each row is scored by itself:
no shuffle but the few partial sums of the rates per source.

Defined results: null and empty texts score 0. Whole texts are read, whatever their length.
Repeated rows are scored alike. A null source forms its own group in the rates.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import product
from math import prod
from re import _constants as sre
from re import _parser as sre_parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 1.0

# ---- Word classes, written naturally; regular-expression alternatives. Fixed values. ----
CLASSES = {
    # addressees and persons spoken about
    "YOU": r"you|your whole team|your team|your (?:boss|driver|clerk|staff|people|company|office|lot)|that clerk of yours|the (?:woman|man|girl|guy|boy) at your desk|whoever (?:wrote|sent|made) this|you people|you lot|all of you",
    "YOUR": r"your|yours|ur",
    # insults that are nouns of their own
    "INSULT": (
        r"idiots?|imbeciles?|cretins?|morons?|half ?wits?|dimwits?|nitwits?|bastards?|wankers?|pricks?|dickheads?|arseholes?|assholes?|shitheads?|scumbags?|scum|"
        r"bitch(?:es)?|son of a bitch|sons of bitches|whores?|sluts?|cunts?|twats?|fuckers?|motherfuckers?|douchebags?|dumb ?ass(?:es)?|jackass(?:es)?|piece of (?:shit|crap|filth|dirt)|sack of (?:shit|crap)|"
        r"losers?|waste of (?:oxygen|space|air|skin)|slobs?|buffoons?|lowlifes?|wretch|blockheads?|numskulls?|brainless|dumbo|nutcase|pigheads?|turds?|bellends?|knobheads?|"
        r"vollidiot(?:en)?|arschloch|arschlocher|wichser|trottel|deppen?|hurensohne?|miststucke?|schlampen?|dreckskerle?|drecksau|drecksacke?|schwachkopf|dummkopf|blodmann|blode kuh|schweinehund|missgeburt|spast|vollpfosten|idiotin|"
        r"connards?|connasses?|salauds?|salopes?|enculer?s?|abrutis?|batards?|ordures?|putes?|cretine?s?|encules|fils de pute|pauvre con|sale con|imbecile|debiles?|raclures?|"
        r"cabron(?:es)?|hijos? de puta|hijoputa|gilipollas|capullos?|imbecil(?:es)?|idiotas?|puta|puto|mamon|pendejos?|cretinos?|subnormal(?:es)?|zorra|malnacidos?|desgraciados?"
    ),
    # words that insult only with an adjective or an addressee
    "BEAST": r"dicks?|jerks?|gits?|penner|tossers?|rats?|snakes?|toads?|cows?|pigs?|swine|worms?|leech(?:es)?|parasites?|monkeys?|apes?|dogs?|donkeys?|mules?|liars?|fools?|clowns?|crooks?|thie(?:f|ves)|thugs?|vermin|weasels?|maggots?|cockroach(?:es)?|goats?|hags?|sheep|vultures?|sau|kuh|schweine?|betruger|ratte|hund|voleurs?|menteurs?|porcs?|ordure|chiens?|ladron(?:es)?|cerdos?|ratas?|burros?|perros?|ape",
    "VILE": (
        r"fat|lazy|ugly|stupid|dumb|filthy|dirty|pathetic|worthless|spineless|crooked|two ?faced|blood ?sucking|brain ?dead|lying|trained|useless|greedy|disgusting|rotten|miserable|"
        r"bloody|fucking|slimy|sneaky|thieving|pathological|complete|utter|total|brainless|hopeless|stinking|vile|cowardly|senile|old|cheating|incompetent|damn|goddamn|"
        r"mieses?|mieser|miese|dummen?|dumme[rs]?|dreckigen?|dreckige[rs]?|fetten?|faulen?|verdammte[rsn]?|elende[rsn]?|blode[rsn]?|kompletter|verlogene[rsn]?|"
        r"sales?|pauvres?|gros(?:se)?|espece d|bande d|putain d|maldit[oa]s?|pedazo d|panda d|asqueros[oa]s?|estupid[oa]s?|sucios?|sucias?"
    ),
    "GROUP": (
        r"(?:(?:all|the|these|those|such) ){0,2}(?:foreigners?|immigrants?|migrants?|refugees|gays?|lesbians|homosexuals|faggots?|queers|trannies|cripples?|disabled|retarded|believers|prayer mumblers|infidels|heathens|"
        r"jews|muslims|christians|hindus|blacks|whites|arabs|asians|africans|gypsies|gipsies|women|females|blondes|old people|old ones from \w+|pensioners|peasants|"
        r"men with that accent|people (?:of|with) that (?:colour|color|skin|accent|faith|kind)|"
        r"auslander|turken|juden|zigeuner|schwule|behinderte|fluchtlinge|weiber|kanaken|etrangers?|immigres|arabes|juifs|pedes|tziganes|handicapes|"
        r"extranjer[oa]s?|inmigrantes|moros|judios|gitanos|maricones|sudacas|mujeres|minusvalidos)|"
        r"(?:all |all of )?(?:the|these|those) \w+ (?:lot|tribe|folk|people|clan|kind|race|types|women|men)|those people|their kind|people like that|your kind"
    ),
    "HARM": r"kill|shoot|stab|beat|break|smash|slit|burn|hurt|strangle|crush|bury|destroy|cut|punch|kick|murder|hang|drown|bash|rip|choke|bury",
    "BODY": r"legs?|face|throat|head|neck|bones|teeth|arms?|knees?|fingers|skull|nose|jaw|house|car|kids|children|family|wife|brains?",
}

# ---- Weights: how grave a matched clause is; each reaches THRESHOLD alone unless it is discounted. ----
INSULTING, HOSTILE, THREATENING, DEMEANING, SUGGESTIVE = 1.0, 1.25, 2.0, 1.5, 1.25

# ---- Clause patterns: (kind, weight, pattern). {CLASS} inserts a class; ~ allows up to three words between. ----
PATTERNS = [
    # insults
    ("abusive", INSULTING, r"\b(?:{INSULT})\b"),
    ("abusive", INSULTING, r"\b(?:{VILE}) (?:\w+ ){0,1}(?:{BEAST})\b"),
    ("abusive", INSULTING, r"\b(?:you|du|ihr|sie sind|tu es|vous etes|eres|sois)\b ~(?:{VILE}) ~(?:{BEAST})\b"),
    ("abusive", INSULTING, r"\b(?:you|you are an?|you are|you must be an?|what an?|oh|listen you|only an?|like the) (?:little |big )?(?:{BEAST})\b(?! (?:{TRADE}))"),
    ("abusive", INSULTING, r"\b(?:your|you|his|her|their) ~(?:is|are|were) ~(?:{VILE}) (?:{BEAST}|{INSULT})\b"),
    ("abusive", HOSTILE, r"\b(?:fuck|piss|sod|bugger) (?:off|you|yourself|this|them)\b|\bscrew you\b|\bgo fuck\b|\bshut (?:the fuck |your (?:mouth|face|trap) ?)?up you\b|\bshut your (?:mouth|face|trap|gob)\b"),
    ("abusive", HOSTILE, r"\bkiss my (?:arse|ass)\b|\b(?:go|goes) to hell\b|\b(?:can|should|may|will|shall) rot\b|\brot in hell\b|\bget lost you\b|\bburn in hell\b"),
    ("abusive", HOSTILE, r"\byou (?:all )?make me (?:sick|puke|vomit|want to (?:vomit|puke))\b|\bi spit on (?:you|your)\b|\byou disgust me\b|\bi (?:hate|despise|loathe) (?:you|your guts)\b|\bnobody likes you\b|\beverybody hates you\b"),
    ("abusive", INSULTING, r"\bmy (?:dog|cat|cow|donkey|goldfish|grandmother) (?:writes|does|reads|types|counts|works|calculates|can) ~(?:better|than)\b|\ba (?:trained )?(?:ape|monkey|dog|donkey|chimp|pig) (?:would|could|can|does) (?:do |have )?~better\b"),
    ("abusive", INSULTING, r"\bpeople as (?:dense|dumb|stupid|thick|slow) as you\b|\bas (?:dense|dumb|stupid|thick) as (?:you|a brick)\b|\b(?:with|has|have) a face like (?:yours?|that)\b|\byou are the reason\b|\byour (?:mother|mum|parents|father) (?:should|must|would) be ashamed\b|\byour mother ~(?:had|raised) you\b"),
    ("abusive", INSULTING, r"\bdid an? ~raise you\b|\bwere you (?:born|dropped) (?:stupid|on your head)\b|\bhow does an? ~like you (?:keep|get|have) a job\b|\byou (?:have|got) no brains?\b|\byou (?:stink|suck)\b|\bare you (?:stupid|dumb|retarded|braindead|blind or)\b|\bhow (?:stupid|dumb|dense) (?:are|can) you\b"),
    ("abusive", HOSTILE, r"\bhalt (?:die|dein|deine) (?:fresse|maul|klappe|schnauze)\b|\bfahrt? (?:doch )?zur holle\b|\bgeh(?:t)? (?:doch )?zum teufel\b|\bverpiss (?:dich|euch)\b|\bleck mich\b|\bfick (?:dich|euch)\b|\bverrecke?\b|\bscheiss \w+ (?:verein|laden)\b|\bihr seid (?:alle )?(?:{VILE}|{BEAST}|{INSULT})\b|\bdu bist ~(?:dumm|blod|{INSULT})\b"),
    ("abusive", HOSTILE, r"\bferme (?:ta|ta sale) (?:gueule|bouche)\b|\bfermez vos gueules\b|\b(?:va|allez) (?:te|vous) faire (?:foutre|voir|enculer)\b|\bcreve donc\b|\bva crever\b|\bva au diable\b|\bnique ta mere\b|\bta gueule\b|\bespece de ~(?:con|conne|porc|merde)\b"),
    ("abusive", HOSTILE, r"\bvete (?:a la mierda|al infierno|al carajo|a tomar por culo)\b|\bidos a la mierda\b|\bque te (?:jodan|den|follen)\b|\bcallate (?:la boca|ya|pedazo|imbecil|idiota|cabron)\b|\bcomo te atreves ~idiota\b|\bme cago en (?:tu|vuestra|ti)\b|\bpedazo de (?:imbecil|idiota|mierda|animal)\b"),
    ("abusive", INSULTING, r"\b(?:you|you are an?|you are such an?) (?:absolute|bloody|fucking|pathetic|miserable|worthless|useless|stupid|filthy) (?!(?:star|legend|hero|darling|angel|genius|gem|champion|treasure|marvel|love|must|need|invoices?|mistakes?|forms?|weather|traffic|weeks?|days?|printer|system)\b)(?!(?:{TRADE})\b)\w+\b"),
    # threats
    ("abusive", THREATENING, r"\bi (?:will|swear|shall|am going to|am gonna|would love to|want to|ll|could) ~(?:{HARM}) ~(?:you|your|you all)\b"),
    ("abusive", THREATENING, r"\bi (?:slit|smash|break|cut|burn|kill) your (?:{BODY})\b|\b(?:{HARM}) your (?:legs?|face|throat|head|neck|bones|teeth|skull|nose|jaw|knees?)\b(?! of)"),
    ("abusive", THREATENING, r"\b(?:find out|know|knows|found out) (?:where you (?:live|sleep|park)|which car is yours|where your (?:kids|children|family)|your (?:address|street|school))\b|\bwatch your back\b|\byour (?:kids|children|family|wife|husband|daughter|son) (?:will|is going to|are going to) (?:pay|suffer|regret)\b"),
    ("abusive", THREATENING, r"\byou (?:will|ll|are going to) (?:be sorry when|regret ~when my|be dead|die|bleed|suffer)\b|\bmy (?:brothers|friends|cousins|boys|men) (?:pay|will pay|are coming|visit) ~you\b|\b(?:come|coming|be back|return) with (?:a|my) (?:bat|gun|knife|hammer|crowbar|axe)\b"),
    ("abusive", THREATENING, r"\byou (?:deserve|ought|need) to (?:be (?:run over|shot|hanged|beaten|killed|flogged|whipped)|die|burn|suffer|hang)\b|\bsomebody should (?:beat|shoot|hang|slap|kill|punch|run) (?:you|your)\b|\b(?:i )?(?:hope|wish|pray) (?:that )?(?:you|your ~) ~(?:choke|die|rot|burn|drown|crash|suffocate|get cancer|bleed)\b|\bdrop dead\b"),
    ("abusive", THREATENING, r"\b(?:go )?(?:hang|kill|drown|shoot) yourself\b|\bnobody would miss you\b|\bjump off (?:the|a) (?:quay|bridge|roof|cliff|pier|building)\b|\bdo everyone a favour and\b|\bthe world ~better off without you\b"),
    ("abusive", THREATENING, r"\bich (?:bringe?|mache?|schlage?|werde?) (?:dich|euch) ~(?:um|fertig|tot|kaputt|zusammen|umbringen|finden)\b|\bich weiss wo du wohnst\b|\bpass (?:bloss )?auf wenn du\b|\bojala (?:te|os) (?:mueras|murais|pudras|parta un rayo)\b|\bte voy a (?:matar|romper|partir|rajar)\b|\bje vais (?:te|vous) (?:tuer|casser|crever|demolir)\b|\bje sais ou tu habites\b"),
    # hate
    ("hateful", DEMEANING, r"\b(?:{GROUP}) (?:\w+ ){0,3}(?:are|is|sind|sont|son|seid|etes|sois) (?:\w+ ){0,2}(?:vermin|disease|plague|animals|subhuman|parasites|cockroaches|rats|scum|filth|thieves|criminals|inferior|dirt|trash|garbage|stupid|lazy|monkeys|apes|ungeziefer|abschaum|dreck|untermenschen|tiere|vermine|ordures?|parasites|animaux|escoria|animales|basura|parasitos|ratas)\b"),
    ("hateful", DEMEANING, r"\b(?:{GROUP}) (?:\w+ ){0,3}(?:thieves by blood|belong in (?:a|the) (?:cage|zoo|camp|kitchen|jungle)|(?:should|must) (?:not|never) be allowed|(?:should|must|ought to) (?:all )?be (?:driven|thrown|locked|gassed|shot|deported|wiped|put down|sterilised|banned|kept)|have no (?:brains?|soul|place)|stink|breed like|gehoren ~(?:raus|weg|eingesperrt|rausgeschmissen))"),
    ("hateful", DEMEANING, r"\b(?:send|ship|throw|drive|kick) (?:all )?(?:{GROUP}) (?:\w+ ){0,3}(?:back|out|away|home)\b|\bback where they came from\b|\bbefore they infect us\b|\bround up (?:all )?(?:{GROUP})\b|\brid of (?:all )?(?:{GROUP})\b|\b(?:keep|kick) (?:{GROUP}) (?:away|out)\b|\bstink and breed\b|\bbreed like rats\b"),
    ("hateful", DEMEANING, r"\b(?:world|country|city|town|place|office) would be (?:\w+ )?(?:cleaner|better|safer|nicer) without (?:{GROUP})\b|\b(?:never|not|don t) (?:hire|trust|employ|serve|pay) (?:{GROUP})\b(?= (?:they|because|as|for|since))|\b(?:typical of|just like|what do you expect from|no wonder) (?:\w+ ){0,4}(?:{GROUP}) (?:an? )?(?:inferior|have no|\w+ breed|are)|\binferior (?:breed|race|people)\b|\bsubhuman\b"),
    ("hateful", DEMEANING, r"\bwhat happens when (?:{GROUP}) are (?:allowed|permitted|given)\b|\brefuse to (?:deal|work|speak|talk|sit) with (?:{GROUP}) (?:\w+ )?(?:they|because|animals)\b|\b(?:they|these|those) are (?:all )?(?:animals|vermin|subhuman|savages)\b|\b(?:hate|despise|detest|loathe|sick of) (?:all )?(?:{GROUP})\b|\b(?:kill|gas|shoot|hang|deport|burn|exterminate) (?:all )?(?:{GROUP})\b"),
    ("hateful", DEMEANING, r"\b(?:auslander|turken|juden|zigeuner|schwule|fluchtlinge|weiber) wie (?:ihr|du|sie)\b|\bauslander raus\b|\bihr seid ungeziefer\b|\b(?:etrangers?|arabes|juifs|femmes) comme (?:vous|toi)\b|\b(?:extranjer[oa]s?|moros|gitanos|mujeres|inmigrantes) como (?:tu|vosotros|usted|ustedes)\b"),
    # sexual
    ("sexual", SUGGESTIVE, r"\b(?:have|having|want|wanna have|need) (?:\w+ ){0,2}sex with (?:you|me|her|him|us)\b|\bsleep with (?:me|us|you)\b|\bfuck(?:ing)? (?:me|you|her|him)\b(?! off)|\b(?:shag|screw|bang) (?:me|you)\b|\bin bed (?:you and me|with (?:me|you))\b|\b(?:film|see|picture|imagine|imagining) (?:\w+ ){0,2}(?:ourselves|you|us) (?:\w+ ){0,2}(?:in bed|naked|nude|undressed)\b"),
    ("sexual", SUGGESTIVE, r"\b(?:nude|naked|topless|dirty|sexy) (?:pictures?|pics?|photos?|selfies?|videos?) (?:of (?:you|your|yourself|her|him)|please|now|and)\b|\bsend (?:me|us) (?:\w+ ){0,2}(?:nudes|nude|naked|sexy)\b|\bnacktfotos?\b|\bnacktbilder\b|\b(?:photos?|images?) de (?:toi|vous) (?:nue?s?|a poil)\b|\b(?:foto|fotos) (?:tuyas )?(?:desnud[oa]s?)\b|\bfotos desnud\w+|\bdesnud[oa] para mi\b"),
    ("sexual", SUGGESTIVE, r"\b(?:show|feel|touch|see|squeeze|lick|kiss|grab) ~(?:your|those) (?:tits|boobs|breasts|arse|ass|thighs|pussy|cock|dick|nipples|bum)\b|\byour (?:breasts|tits|boobs|arse|ass|thighs|body|legs) (?:\w+ ){0,6}(?:looked|look|touch|in that|turn|make me)\b|\b(?:tits|boobs) on the\b|\bfeel your thighs\b|\bspread your legs\b"),
    ("sexual", SUGGESTIVE, r"\b(?:i (?:get|am|got)|so|feeling|makes me) (?:so )?horny\b|\bblow ?job\w*|\b(?:blowjobs?|handjobs?)\b|\bmy (?:cock|dick|penis) is\b|\bsuck my\b|\b(?:lick|licking) you\b|\bare you wet\b|\bstrip for (?:me|us)\b|\btake off your (?:clothes|shirt|blouse|bra|dress|pants|panties)\b|\bhotel room (?:tonight|and)\b|\bmake love to (?:you|me)\b"),
    ("sexual", SUGGESTIVE, r"\b(?:ich will|willst du|lass uns) ~(?:ficken|bumsen|vogeln|mit dir schlafen|sex)\b|\bzeig mir (?:deine|mal deine) (?:titten|bruste|muschi)\b|\bzieh dich (?:fur mich )?aus\b|\b(?:couche|coucher) avec (?:moi|toi)\b|\b(?:montre|montrez) moi tes (?:seins|fesses)\b|\bj ai envie de (?:toi|te baiser)\b|\b(?:acuestate|acostarme|follar|foll[oa]) ~(?:conmigo|contigo)\b|\bensename (?:tus|las) tetas\b|\bquitate la ropa\b"),
]

# ---- Transducers that take the sting out before scoring. ----
# Trade terms: what follows or precedes an insulting word and makes it a thing.
TRADE = (
    r"proof|cut|files?|iron|waiters?|wrench(?:es)?|poison|valves?|tiles?|green|plugs?|box(?:es)?|nails?|eyed|bells?|racks?|stock|hides?|skins?|feed|wood|trucks?|traps?|control|"
    r"manifests?|bristles?|leather|meat|milk|pens?|hair|head|tail|wire|gear|tents?|screws?|pumps?|repairs?|cylinders?|orange|concentrate|jerky|bars?|fish|stalls?|nest"
)
HARMLESS = [
    (r"\b(?:{INSULT}|{BEAST}|bloody|dumb|dead|naked|nude|cock|nipple|slave|kill|hot|breast|strip) (?:{TRADE})\b", " _ "),
    (r"\b(?:idiot|fool) (?:proof)\b|\bbastard cut\b|\bcock ?(?:eyed|valve|pit|tail)\w*|\bstop ?cocks?\b|\bkill (?:switch|rate|fee)\b|\bkilled the (?:deal|engine|order|line)\b|\bbeat us to\b|\bwet (?:paint|weight|storage|goods|cement)\b", " _ "),
    (r"\bstrip (?:the|off the|all) (?:cable|wire|paint|ends|insulation|threads?)\b|\bbreast (?:pumps?|pads?|plates?|fillets?)\b|\bnude (?:tights|colour|color|shade|hosiery)\b|\bsex (?:female|male|mixed|ratio|of the)\b|\brefugee (?:aid|camp|parcels|tents|relief)\b", " _ "),
    (r"\b(?:piece|pieces) of (?:dirt track|equipment)\b|\bthieves? (?:guild|market|insurance)\b|\bnobody (?:is|was|has|answered|replied|signed|could|would|at|in|from|here|knows|called|came|checked|picked)\b(?! miss you)", " _ "),
]
# Rules of conduct, policies and reports about behaviour: the clause states no abuse of its own.
CONDUCT = re.compile(
    r"\b(?:policy|policies|house rules?|rules? of conduct|code of conduct|guidelines?) (?:\w+ ){0,3}(?:bans?|forbids?|prohibits?|rules? out|on|against)\b|\bcode of conduct\b|\bharassment\b|"
    r"\bzero tolerance\b|\b(?:abusive|hateful|offensive|sexist|racist) (?:language|remarks|speech|behaviour|behavior|or)\b|\bremarks towards\b|\b(?:is|are) (?:prohibited|forbidden|banned)\b|"
    r"\bnot tolerated\b|\bleads? to a closed\b|\bverhaltensregeln\b|\brichtlinie\b|\breglement interieur\b|\bnormas de conducta\b"
)
# Reported speech about a third person discounts; direct speech to the reader does not.
REPORTED = re.compile(r"\b(?:he|she|they|the (?:driver|clerk|customer|caller|guard|man|woman)) (?:said|wrote|shouted|claims|claimed|called (?:me|us|him|her|them))\b|\b(?:was|were|been|got|being) called an?\b|\baccording to (?:him|her|them)\b")
# The addressee: such a word in the match, or one that opens an address up to three words before it or right behind it.
_YOU_IN = re.compile(r"\b(?:you|your|yours|ur|yourself|du|ihr|dich|euch|dein|deine|tu|ta|te|tes|toi|vous|vos|vosotros|tus|eres|sois|contigo)\b")
_YOU_BEFORE = re.compile(r"\b(?:you|du|ihr|tu|vous|eres|sois)(?: \S+){0,3} $")
_YOU_BEHIND = re.compile(r" (?:you|du|ihr|tu|vous)\b")
# What is left of a weight under a discount.
CONDUCT_WEIGHT, REPORTED_WEIGHT, NEGATED_WEIGHT = 0.1, 0.3, 0.3
# A phrase governs a match that is at most so many words away.
GOVERNS = 8
NEGATED = re.compile(r"\b(?:is|are|was|were|am) (?:not|no|never) an? (?:\w+ )?(?:{INSULT}|{BEAST})\b".replace("{INSULT}", CLASSES["INSULT"]).replace("{BEAST}", CLASSES["BEAST"]))

_HIDDEN = re.compile("[­͏​-‏‪-‮⁠-⁤﻿]")
_LEET = str.maketrans("@4831!05$7€£", "aabeiiosstel")
_LOOKALIKE = str.maketrans("аеорсухіјѕԁɡνοαε", "aeopcyxijsdgvoae")
_SPELLED = re.compile(r"(?<![\w@$*#])[\w@$*#]([ ._-])[\w@$*#](?:\1[\w@$*#])+(?![\w@$*#])")
_TOKEN = re.compile(r"[\w@$*#€£!]+")
_CLAUSE = re.compile(r"[.!?;:\n\r]+\s|[\n\r]+|[!?]+$")


def _squeeze(text: str) -> str:
    return re.sub(r"([^\W\d_])\1+", r"\1", text)


def _build(pattern: str) -> str:
    """The regular expression of a pattern: classes composed into it, gaps written out."""
    known = {**CLASSES, "TRADE": TRADE}
    composed = re.sub(r"\{([A-Z]+)\}", lambda m: known[m[1]], pattern)
    return _squeeze_regex(composed.replace("~", r"(?:\w+ ){0,3}"))


def _squeeze_regex(source: str) -> str:
    """The pattern with doubled letters reduced like the text; escapes and class names stay."""
    return re.sub(r"(?<!\\)([a-z])\1+", r"\1", source)


@cache
def _common() -> frozenset[str]:
    """Everyday words, squeezed like the texts; one alone says nothing about a clause."""
    words = (
        "the and of to in is are you your for with on at my me we us our it this that all be will have has not no from by or as an a was were they them who what how like out off up "
        "people office money job team driver boss clerk woman desk car back now day word time people better place town city country company number address street school car house "
        "pay visit keep get got has put send see show feel want need know find take make let go come do does did can could would should may must shall am old big little complete total dirty "
        "two since because before without kind run lot lots rate so which when please return works deal back staff open there these those same first last half item sent call see live need lot types mark "
        "auf mit fur aus zum um an am im zu auch so nicht ohne nach bis wird von vom l d j au pas va ne ce ou ya las lo al su sus mi tu "
        "de la du die der den dem des das ihr sie sind et un une des les vous tu te que el los las en con lo se es son para por como una wie wir ich es"
    )
    return frozenset(map(_squeeze, words.split()))


@cache
def grammar() -> tuple:
    """Compiled patterns, harmless transducers, trigger words and the vocabulary for masked letters."""
    rules = [(kind, weight, re.compile(_build(p))) for kind, weight, p in PATTERNS]
    harmless = [(re.compile(_build(p)), r) for p, r in HARMLESS]
    sources = [*(p for _, _, p in PATTERNS), *CLASSES.values()]
    words = set()
    for source in sources:
        plain = re.sub(r"\{\w+\}|\\[bws]|\(\?[:!=]|[~^$]", " ", source)
        # A letter or group that may be missing gives both spellings.
        for raw in re.findall(r"[a-z]+(?:\?|\((?!\?)?[^)]*\))?[a-z?]*", plain.replace("(?:", "(")):
            for w in {re.sub(r"[a-z]\?|[()|?]", "", raw), re.sub(r"[()|?]", "", raw)}:
                if len(w) > 1:
                    words.add(_squeeze(w))
    by_length: dict[int, list[str]] = {}
    for w in sorted(words):
        by_length.setdefault(len(w), []).append(w)
    triggers = {w for w in words if w not in _common()}
    return rules, harmless, triggers, by_length


def _texts(item) -> set[str] | None:
    """All texts a part of a parsed pattern matches, None if they are not a short list."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg)}
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        return {chr(c) for _, c in arg}
    if op is sre.SUBPATTERN:
        return _sequence_texts(arg[3])
    if op is sre.BRANCH:
        each = [_sequence_texts(a) for a in arg[1]]
        return None if None in each else set().union(*each)
    if op is sre.MAX_REPEAT and arg[:2] == (0, 1):
        inner = _sequence_texts(arg[2])
        return None if inner is None else inner | {""}
    return None


def _sequence_texts(items) -> set[str] | None:
    texts = {""}
    for item in items:
        more = _texts(item)
        if more is None or len(texts) * len(more) > 5000:
            return None
        texts = {a + b for a in texts for b in more}
    return texts


def _parts(items) -> list[frozenset[str]]:
    """Sets of letter runs of which every match of a parsed sequence holds at least one each."""
    parts, texts = [], {""}

    def close() -> None:
        runs = [re.findall("[a-z]+", t) for t in texts]
        if all(runs):
            parts.append(frozenset(max(r, key=len) for r in runs))
        texts.clear()
        texts.add("")

    for item in items:
        op, arg = item
        more = _texts(item)
        if more is not None and len(texts) * len(more) <= 5000:
            texts = {a + b for a in texts for b in more}
            if more == {" "}:
                close()
            continue
        close()
        if op is sre.SUBPATTERN:
            parts += _parts(arg[3])
        elif op is sre.BRANCH:
            each = [_parts(a) for a in arg[1]]
            if all(each):  # of each way the part of least common words
                common = _common()
                parts.append(frozenset().union(*(min(p, key=lambda part: (len(part & common), len(part))) for p in each)))
        elif op is sre.MAX_REPEAT and arg[0] > 0:
            parts += _parts(arg[2])
    close()
    return parts


def _ways(items) -> list[list[frozenset[str]]]:
    """The parts of each alternative of a parsed pattern."""
    wide = [i for i in items if i[0] is not sre.AT]
    if len(wide) == 1 and wide[0][0] is sre.BRANCH:
        return [w for a in wide[0][1][1] for w in _ways(a)]
    if len(wide) == 1 and wide[0][0] is sre.SUBPATTERN:
        return _ways(wide[0][1][3])
    return [_parts(items)]


@cache
def _required() -> tuple[dict[str, int], list[list[int]]]:
    """Letter runs with the bits of the parts they belong to; for each rule, and behind them each harmless pattern, the bits of its alternatives."""
    bits: dict[frozenset[str], int] = {}
    needs = [
        [sum(1 << bits.setdefault(p, len(bits)) for p in set(parts)) for parts in _ways(sre_parser.parse(pattern.pattern))]
        for pattern in [*(p for _, _, p in grammar()[0]), *(p for p, _ in grammar()[1])]
    ]
    runs: dict[str, int] = {}
    for part, bit in bits.items():
        for run in part:
            runs[run] = runs.get(run, 0) | 1 << bit
    return runs, needs


@cache
def _longest_run() -> int:
    return max(map(len, _required()[0]))


@lru_cache(maxsize=1 << 18)
def _word_bits(word: str) -> int:
    """The parts a word may belong to: those with a run found anywhere in it."""
    runs = _required()[0]
    longest, found = _longest_run(), 0
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + longest) + 1):
            found |= runs.get(word[i:j], 0)
    return found


@cache
def _keys() -> tuple[int, dict[int, list[tuple[int, int]]]]:
    """The key parts, and under each the (parts, rule) of its alternatives.

    The key of an alternative is its part of the least common words. A clause without any key
    matches no rule, and with some of them only those filed there.
    """
    runs, needs = _required()
    common = _common()
    weight: dict[int, tuple[int, int]] = {}
    for run, bits in runs.items():
        while bits:
            bit = bits & -bits
            bits ^= bit
            a, b = weight.get(bit, (0, 0))
            weight[bit] = (a + (run in common or len(run) < 3), b + 1)
    filed: dict[int, list[tuple[int, int]]] = {}
    for rule, ways in enumerate(needs):
        for need in set(ways):
            parts = [1 << i for i in range(need.bit_length()) if need >> i & 1]
            filed.setdefault(min(parts, key=weight.__getitem__) if parts else 0, []).append((need, rule))
    return sum(filed), filed


@lru_cache(maxsize=1 << 18)
def _possible(found: int) -> tuple[int, ...]:
    """The rules that can match a clause whose words belong to these parts."""
    return tuple(k for k in _filed_under(found) if k < len(PATTERNS))


@lru_cache(maxsize=1 << 16)
def _softened(found: int) -> tuple[int, ...]:
    """The harmless patterns that can match such a clause."""
    return tuple(k - len(PATTERNS) for k in _filed_under(found) if k >= len(PATTERNS))


def _filed_under(found: int) -> list[int]:
    mask, filed = _keys()
    rules = {rule for _, rule in filed.get(0, ())}
    here = found & mask
    while here:
        bit = here & -here
        here ^= bit
        rules |= {rule for need, rule in filed[bit] if not need & ~found}
    return sorted(rules)


@cache
def _conduct() -> re.Pattern:
    return re.compile(_squeeze_regex(CONDUCT.pattern))


@lru_cache(maxsize=1 << 16)
def _readings(token: str) -> tuple[str, ...]:
    """What a token may stand for: the grammar's words under a mask (``f*ck``), or two words run together (``yourtits``)."""
    _, _, triggers, by_length = grammar()
    if "*" in token or "#" in token:
        pattern = re.compile("".join("." if c in "*#" else re.escape(c) for c in token))
        found = tuple(w for w in by_length.get(len(token), ()) if pattern.fullmatch(w))
        return found or (re.sub(r"[*#]", "", token),)
    if len(token) >= 6 and token not in triggers:
        return (token, *(" ".join(ws) for ws in _segments(token) if len(ws) > 1 and max(map(len, ws)) >= 4 and not triggers.isdisjoint(ws)))
    return (token,)


def _segments(token: str) -> list[tuple[str, ...]]:
    """All ways to read a token as words of the grammar run together."""
    known, longest = _plain_words()
    n = len(token)
    ends = [False] * n + [True]
    for i in range(n - 1, -1, -1):
        ends[i] = any(ends[j] and token[i:j] in known for j in range(i + 1, min(n, i + longest) + 1))
    found, open_ = [], [(0, ())] if ends[0] else []
    while open_:
        i, words = open_.pop()
        if i == n:
            found.append(words)
        open_ += [(j, (*words, token[i:j])) for j in range(i + 1, min(n, i + longest) + 1) if ends[j] and token[i:j] in known]
    return sorted(found)


@cache
def _plain_words() -> tuple[set[str], int]:
    """The grammar's words and the length of the longest."""
    _, _, triggers, by_length = grammar()
    words = triggers | {w for ws in by_length.values() for w in ws} | {"a", "i"}
    return words, max(map(len, words))


def plain_text(text: str) -> str:
    """The text in lower case with hidden characters, widths, accents, look-alikes and spelled-out words undone."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
        for c in {c for c in set(text) if ord(c) in _LOOKALIKE}:
            text = text.replace(c, chr(_LOOKALIKE[ord(c)]))
        if not text.isascii():
            text = unicodedata.normalize("NFKD", text)
            for c in {c for c in set(text) if unicodedata.combining(c)}:
                text = text.replace(c, "")
    return _SPELLED.sub(lambda m: m[0].replace(m[1], ""), text.casefold())


@lru_cache(maxsize=1 << 18)
def _plain_token(token: str) -> tuple[str, tuple[str, ...], int] | None:
    """A token as a plain word, its readings and the parts any of them may belong to; None if nothing is left."""
    if not token.isalpha():
        token = token.strip("!_")
        if any(c.isalpha() for c in token):
            token = _squeeze(token.translate(_LEET))
        token = token.replace("_", " ").strip()
    else:
        token = _squeeze(token)
    if not token:
        return None
    ways, bits = _readings(token), 0
    for w in ways:
        bits |= _word_bits(w)
    return token, ways, bits


def plain_clauses(text: str) -> list[list[str]]:
    """Clauses of plain words, with disguises undone."""
    out = []
    for clause in _CLAUSE.split(plain_text(text)):
        words = [found[0] for found in map(_plain_token, _TOKEN.findall(clause)) if found]
        if words:
            out.append(words)
    return out


def score_clause(clause: str, possible: tuple[int, ...] | None = None, softened: tuple[int, ...] | None = None) -> dict[str, float]:
    """Best weight of each kind in a clause of plain words, after the discounting transducers.

    ``possible`` are the rules and ``softened`` the harmless patterns to run, all without them.
    """
    rules, harmless, _, _ = grammar()
    if possible is not None:
        rules = [rules[k] for k in possible]
    if softened is not None:
        harmless = [harmless[k] for k in softened]
    for pattern, replacement in harmless:
        clause = pattern.sub(replacement, clause)
    discounts = None
    best: dict[str, float] = {}
    for kind, weight, pattern in rules:
        found = pattern.search(clause)
        while found and weight > best.get(kind, 0.0):
            if discounts is None:
                discounts = [[m.span() for m in p.finditer(clause)] for p in (_conduct(), REPORTED, NEGATED)]
            conduct, reported, negated = discounts
            here = weight
            if (conduct or reported) and not _to_you(clause, *found.span()):
                if _governed(clause, found.span(), conduct, GOVERNS):
                    here *= CONDUCT_WEIGHT
                if _governed(clause, found.span(), reported, GOVERNS):
                    here *= REPORTED_WEIGHT
            if kind == "abusive" and any(a < found.end() and found.start() < b for a, b in negated):
                here *= NEGATED_WEIGHT
            if here > best.get(kind, 0.0):
                best[kind] = here
            found = pattern.search(clause, found.start() + 1)
    return best


def _to_you(clause: str, start: int, end: int) -> bool:
    return bool(_YOU_IN.search(clause, start, end) or _YOU_BEFORE.search(clause, 0, start) or _YOU_BEHIND.match(clause, end))


def _governed(clause: str, match: tuple[int, int], phrases: list[tuple[int, int]], reach: int) -> bool:
    """Whether one of the phrases overlaps the match or lies at most ``reach`` words off."""
    start, end = match
    return any(len(clause[b:start].split()) <= reach if b <= start else len(clause[end:a].split()) <= reach for a, b in phrases)


def _automaton(items, after: int, steps: list) -> int:
    """Adds the states of a parsed sequence that goes on at ``after``; its first state. Lookaheads are left to the check of a found reading."""
    for op, arg in reversed(list(items)):
        if op in (sre.ASSERT, sre.ASSERT_NOT):
            continue
        if op is sre.SUBPATTERN:
            after = _automaton(arg[3], after, steps)
            continue
        if op is sre.BRANCH:
            step = ("any of", [_automaton(a, after, steps) for a in arg[1]])
        elif op is sre.AT and arg is sre.AT_BOUNDARY:
            step = ("boundary", [after])
        elif op is sre.LITERAL:
            step = (re.compile(re.escape(chr(arg))), [after])
        elif op is sre.IN:
            inside = "".join("\\w" if o is sre.CATEGORY and c is sre.CATEGORY_WORD else "\\S" if o is sre.CATEGORY and c is sre.CATEGORY_NOT_SPACE else re.escape(chr(c)) for o, c in arg)
            step = (re.compile(f"[{inside}]"), [after])
        elif op is sre.MAX_REPEAT:
            low, high, inner = arg
            if high is sre.MAXREPEAT:
                steps.append(("any of", [after]))
                loop = len(steps) - 1
                steps[loop][1].append(_automaton(inner, loop, steps))
                after = loop
            else:
                end = after
                for _ in range(high - low):
                    steps.append(("any of", [end, _automaton(inner, after, steps)]))
                    after = len(steps) - 1
            for _ in range(low):
                after = _automaton(inner, after, steps)
            continue
        else:
            raise ValueError(f"no step for {op}")
        steps.append(step)
        after = len(steps) - 1
    return after


@cache
def _rule_automaton(k: int) -> tuple[list, int]:
    steps: list = [("found", [])]
    return steps, _automaton(sre_parser.parse(grammar()[0][k][2].pattern), 0, steps)


@lru_cache(maxsize=1 << 16)
def _walk(k: int, states: frozenset[int], word: str, first: bool, last: bool) -> tuple[frozenset[int], bool]:
    """The states of rule ``k`` behind a word and its blank, and whether a match ended on the way."""
    steps, start = _rule_automaton(k)
    is_word = lambda c: c.isalnum() or c == "_"
    text, found, before = word if last else word + " ", False, "" if first else " "
    for c in [*text, ""] if last else text:
        todo, seen = [*states, start], set()
        while todo:
            if (x := todo.pop()) in seen:
                continue
            seen.add(x)
            what, to = steps[x]
            if what == "any of" or what == "boundary" and is_word(before) != is_word(c):
                todo += to
        found |= 0 in seen
        states = frozenset(to[0] for what, to in (steps[x] for x in seen) if isinstance(what, re.Pattern) and c and what.fullmatch(c))
        before = c
    return states, found


@cache
def _discounting() -> frozenset[str]:
    """Words of the transducers that discount."""
    sources = [*(p.pattern for p, _ in grammar()[1]), _conduct().pattern, REPORTED.pattern]
    return frozenset(w for source in sources for w in re.findall("[a-z]+", re.sub(r"\\.", " ", source)))


def score_lattice(readings: list[tuple[str, ...]], possible: tuple[int, ...], softened: tuple[int, ...] | None = None) -> dict[str, float]:
    """Best weight of each kind over all readings of a clause, without listing them.

    Each rule's automaton walks over the readings of one token after the other. Of readings that
    lead to the same states one goes on, that with fewest discounting words; each reading that
    ends a match is scored as a clause, the tokens behind it read as harmlessly as can be.
    """
    rules, discounting = grammar()[0], _discounting()
    cost = [[sum(w in discounting for w in r.split()) for r in ways] for ways in readings]
    plain = [ways[c.index(min(c))] for ways, c in zip(readings, cost)]
    best: dict[str, float] = {}
    for k in possible:
        kind, weight, _ = rules[k]
        front: dict[frozenset[int], tuple] = {frozenset(): (0, None)}
        for i, ways in enumerate(readings):
            ahead: dict[frozenset[int], tuple] = {}
            for states, (so_far, path) in front.items():
                ends = set()
                for r, more in sorted(zip(ways, cost[i]), key=lambda x: x[1]):
                    if best.get(kind, 0.0) >= weight:
                        break
                    to, found = _walk(k, states, r, i == 0, i == len(readings) - 1)
                    way = (so_far + more, (path, r))
                    if found and (to, more) not in ends:
                        ends.add((to, more))
                        words, at = [], way[1]
                        while at:
                            words.append(at[1])
                            at = at[0]
                        for name, w in score_clause(" ".join([*reversed(words), *plain[i + 1 :]]), (k,), softened).items():
                            best[name] = max(best.get(name, 0.0), w)
                    if to not in ahead or way[0] < ahead[to][0]:
                        ahead[to] = way
            front = ahead
            if best.get(kind, 0.0) >= weight:
                break
    return best


def score_text(text: str | None) -> tuple[float, float, float]:
    """(abusive, hateful, sexual) weight of a text: of each clause the best reading of its masked words counts."""
    totals = {"abusive": 0.0, "hateful": 0.0, "sexual": 0.0}
    if not text:
        return 0.0, 0.0, 0.0
    for clause in _CLAUSE.split(plain_text(text)):
        tokens = [found for found in map(_plain_token, _TOKEN.findall(clause)) if found]
        parts = 0
        for token in tokens:
            parts |= token[2]
        possible = _possible(parts)
        if not possible:
            continue
        readings = [token[1] for token in tokens]
        if prod(map(len, readings)) <= 64:
            best: dict[str, float] = {}
            for clause in map(" ".join, product(*readings)):
                for kind, weight in score_clause(clause, possible, _softened(parts)).items():
                    best[kind] = max(best.get(kind, 0.0), weight)
        else:
            best = score_lattice(readings, possible, _softened(parts))
        for kind, weight in best.items():
            totals[kind] += weight
    return totals["abusive"], totals["hateful"], totals["sexual"]


_SCORES = T.StructType().add("abusive", T.DoubleType()).add("hateful", T.DoubleType()).add("sexual", T.DoubleType())


@F.pandas_udf(_SCORES)
def _score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([score_text(t) for t in batch], columns=["abusive", "hateful", "sexual"])


def score_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual, score, flagged) of every document."""
    scored = documents.select("doc_id", "source", _score(F.coalesce("text", F.lit(""))).alias("s"))
    total = F.col("s.abusive") + F.col("s.hateful") + F.col("s.sexual")
    return scored.select("doc_id", "source", "s.*", total.alias("score"), (total >= THRESHOLD).alias("flagged"))


def source_rates(documents: DataFrame) -> DataFrame:
    """(source, n_documents, n_flagged, rate and the rate of each kind); partial sums are combined map-side."""
    s = score_documents(documents)
    share = lambda c: F.bround(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return s.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"), share(F.col("flagged")).alias("rate"),
        share(F.col("abusive") >= THRESHOLD).alias("abusive_rate"), share(F.col("hateful") >= THRESHOLD).alias("hateful_rate"),
        share(F.col("sexual") >= THRESHOLD).alias("sexual_rate"),
    )
