"""Fixed values of the rules: word lists, patterns and thresholds, as data. Patterns are Java's, case-insensitive where used so."""

from __future__ import annotations

# Number words and what they stand for.
SMALL_NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19,
}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
SCALES = {"hundred": 100, "thousand": 1000, "million": 1000000}

# Words at whose full stop no sentence ends.
ABBREVIATIONS = (
    "al.", "e.g.", "i.e.", "Fig.", "Figs.", "Eq.", "Eqs.", "Ref.", "Refs.",
    "vs.", "approx.", "ca.", "cf.", "No.", "Dr.", "Prof.",
)

# Stock phrases, as alternatives of a pattern.
STOCK_PHRASES = (
    "furthermore", "moreover", "additionally", "notably", "ultimately",
    "in conclusion", "in summary", "in short", "to summarize",
    "it is (?:important|crucial) to note", "pivotal", "vital role",
    "integral role", "tapestry", "delves? into", "testament", "paramount",
    "transformative potential", "the landscape of", "cornerstone", "synergy",
    "holistic", "to (?:address|resolve|overcome|mitigate) these",
    "this study (?:highlights|outlines)", "reveals exactly", "must deploy",
    "must integrate", "must establish", "hinges on", "as the demand for",
    "interplay", "intricacies", "meticulously", r"garner\w*", r"bolster\w*",
    r"showcas\w*", r"foster\w*", "underscore[sd]?", "renowned", "nestled",
    "groundbreaking", "deep dive", "vibrant", "enduring", "exemplifies",
    "valuable insights", "boasts?",
    r"not only\b[^.;]{1,120}?\bbut also",
)

# Words in -ing that end no clause.
NOT_PARTICIPLES = (
    "during", "including", "according", "regarding", "concerning",
    "notwithstanding", "nothing", "something", "anything", "everything",
    "string", "spring", "bring", "thing", "morning", "evening", "ceiling",
)

# Classes of hedges, as alternatives of a pattern.
HEDGES = {
    "possibility": "may|might|could|possibly|potentially|perhaps",
    "frequency": "often|frequently|occasional(?:ly)?|sometimes|typically|usually|generally|commonly|rarely",
    "evidential": "suggest(?:s|ed|ing)?|indicat(?:e|es|ed|ing)|appear(?:s|ed)?|seem(?:s|ed)?|likely|unlikely|impl(?:y|ies|ied|ying)|points? to",
    "limiting": "some|certain|partly|partially|largely|mostly|strongly|slightly|relatively|(?<!not )only",
}
# Markers of certainty.
CERTAINTY = (
    "clearly", "undeniably", "undoubtedly", "unquestionably", "indisputably", "incontrovertibly",
    "definitively", "certainly", "obviously", "evidently", "plainly", "assuredly",
    "without (?:a )?doubt", "beyond (?:any )?doubt", "needless to say",
)

# Words that are no content, and more of them for the first words of a sentence.
STOPWORDS = tuple(
    "that this these those with from into have been their there which while where when what about across "
    "through under over than then they them also such some more most only very will would should could "
    "being were does upon onto each other both well much many".split()
)
FRAME_STOPWORDS = STOPWORDS + tuple("the a an of in on to and or for is are was were it its our we this by as at be".split())

# Endings and connectors that add an item.
ADD_ON_ENDINGS = "too|as well|alongside (?:it|them)|the same (?:effect|treatment)"
ADD_ON_CONNECTORS = "also|alongside|along with|together with"
# Words that give an acronym no letter.
ACRONYM_STOPWORDS = ("of", "and", "the", "for", "in", "on", "to", "a", "an", "by", "with")

# Pronouns that refer back or to persons; "that" is none of them.
PRONOUNS = (
    "i", "we", "us", "me", "my", "our", "mine", "ours", "myself", "ourselves",
    "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "this", "these", "those",
)
# Endings of nouns made from verbs and adjectives, and words that only look so.
NOMINAL = "[a-z]{2,}(?:tions?|sions?|ments?|ness(?:es)?|ities|ity|ances?|ences?|isms?)"
NOT_NOMINAL = (
    "moment", "moments", "comment", "comments", "cement", "garment", "garments",
    "element", "elements", "segment", "segments", "pigment", "pigments",
    "fragment", "fragments", "ornament", "ornaments", "parliament", "density",
    "entity", "quantity", "quantities", "city", "cities",
)
# The nominal endings of the label study, which differ from those above.
LABEL_NOMINAL = r"\w{3,}(?:tions?|sions?|ments?|ness|ity|ities|ances?|ences?|isms?)"
# Forms that begin a passive, and participles not in -ed.
PASSIVE_BE = "am|is|are|was|were|be|been|being|gets?|got|gotten"
PASSIVE_IRREGULAR = (
    "born", "done", "made", "given", "taken", "seen", "known", "shown", "found",
    "held", "built", "set", "put", "written", "drawn", "grown", "kept", "led",
    "sent", "told", "left", "lost", "meant", "read", "cut", "hit", "let", "met",
    "paid", "said", "sold", "won", "run", "begun", "chosen", "driven", "proven",
    "broken", "spoken", "frozen", "stolen", "risen", "fallen", "thrown", "brought",
    "bought", "caught", "taught", "fought", "sought",
)

# Ordinals that an enumeration goes through.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth")

# Plainer words, without change of meaning.
REGISTER = {
    "utilize": "use", "utilizes": "uses", "utilized": "used", "utilizing": "using", "utilization": "use",
    "leverage": "use", "leverages": "uses", "leveraging": "using",
    "facilitate": "help", "facilitates": "helps", "facilitated": "helped",
    "demonstrate": "show", "demonstrates": "shows", "demonstrated": "showed", "demonstrating": "showing",
    "commence": "begin", "commences": "begins", "commenced": "began",
    "ascertain": "find", "ascertains": "finds", "ascertained": "found",
    "comprise": "include", "comprises": "includes", "comprised": "included",
    "encompass": "cover", "encompasses": "covers", "encompassed": "covered",
    "induce": "cause", "induces": "causes", "induced": "caused",
    "amplify": "increase", "amplifies": "increases", "amplified": "increased",
    "mitigate": "reduce", "mitigates": "reduces", "mitigated": "reduced",
    "numerous": "many", "myriad": "many", "plethora": "many",
    "additional": "more", "approximately": "about", "sufficient": "enough", "individuals": "people",
    "apparel": "clothing", "storefront": "website", "storefronts": "websites",
    "prior to": "before", "subsequent to": "after", "in order to": "to",
    "due to the fact that": "because", "in the event that": "if",
    "the majority of": "most", "a number of": "several", "with regard to": "about", "a myriad of": "many",
}

# Ordered rewrite rules, pattern and replacement ($n is a group).
PHRASES = (
    (r"\b[Ff]urthermore,\s*", ""), (r"\b[Mm]oreover,\s*", ""), (r"\b[Aa]dditionally,\s*", ""),
    (r"\b[Nn]otably,\s*", ""), (r"\b[Uu]ltimately,\s*", ""), (r"\b[Ii]n conclusion,\s*", ""),
    (r"\b[Ii]t is important to note that\s*", ""), (r"\b[Ii]t is crucial to note that\s*", ""),
    (r"\b[Tt]o summarize,\s*", ""), (r"\b[Ii]n summary,\s*", ""), (r"\b[Ii]n short,\s*", ""),
    (r"\b[Tt]he motivation is obvious:\s*", "The motivation is obvious. "),
    (r"\b[Tt]o resolve these limitations,\s*we\b", "We"), (r"\b[Tt]o address these challenges,\s*we\b", "We"),
    (r"\b[Tt]o overcome these hurdles,\s*we\b", "We"), (r"\b[Tt]o mitigate these risks,\s*we\b", "We"),
    (r"\b[Tt]his study outlines\b", "We examine"), (r"\b[Tt]his study highlights\b", "We examine"),
    (r"\b[Tt]hese findings offer design principles for\b", "These findings establish guidelines for"),
    (r"\b[Rr]eveals exactly when and where\b", "pinpoints the spatial onset of"),
    (r"\b[Rr]eveals when and where\b", "pinpoints where"),
    (r"\b[Ss]erves as a testament to\b", "demonstrates"), (r"\b[Pp]ivotal role\b", "direct role"),
    (r"\b[Vv]ital role\b", "direct role"), (r"\b[Ii]ntegral role\b", "direct role"),
    (r"\b[Tt]apestry of\b", "range of"), (r"\b[Dd]elve into\b", "examine"), (r"\b[Dd]elves into\b", "examines"),
    (r"\b[Pp]aramount\b", "essential"), (r"\b[Tt]ransformative potential\b", "capacity"),
    (r"\b[Tt]he landscape of\b", "current"), (r"\b[Cc]ornerstone of\b", "foundation of"),
    (r"\b[Ss]erves as a cornerstone\b", "forms the basis"),
    (r"\bCommercial success demands synergy\.\s*", ""), (r"\bCross-disciplinary teams drive scaling\.\s*", ""),
    (r"\bSynergy ensures commercial viability\.\s*", ""),
)
MODALS = (
    (r"\bmust deploy\b", "need to deploy"), (r"\bmust integrate\b", "integrates"), (r"\bmust establish\b", "needs to establish"),
    (r"\bmust match experiment\b", "aligns with experiment"), (r"\bhinges on aligning\b", "requires aligning"),
    (r"\bhinges on\b", "depends on"), (r"\bis paramount for establishing\b", "is necessary to establish"),
    (r"\bis paramount for\b", "is necessary for"),
    (r"\boffer a viable pathway to accommodate\b", "accommodates"), (r"\boffers a viable pathway to accommodate\b", "accommodates"),
    (r"\boffer a viable pathway to\b", "can"), (r"\boffers a viable pathway to\b", "can"),
)
HOWEVER = (
    (r"([.?!]\s+)([A-Z][a-z0-9_-]+),\s*however,\s*([a-z0-9\s_-]+)", "$1Yet $2 $3"),
    (r"\b([A-Za-z0-9_-]+),\s*however,\s*", "Yet $1 "),
)
# Clauses that become a sentence; in a rule with a mark the group's first letter becomes large, the rest small.
CAPITAL = "^"
TAILS = (
    (r",\s+with\s+([a-zA-Z0-9_\-\s]+?)\s+jumping\s+", ". ^$1^ jumped "), (r",\s+with\s+([a-zA-Z0-9_\-\s]+?)\s+rising\s+", ". ^$1^ rose "),
    (r",\s+with\s+([a-zA-Z0-9_\-\s]+?)\s+dropping\s+", ". ^$1^ dropped "),
    (r",\s+with\s+([a-zA-Z0-9_\-\s]+?)\s+increasing\s+by\s+", ". ^$1^ increased by "),
    (r",\s+cutting\s+", ". This cut "), (r",\s+raising\s+", ". This raised "), (r",\s+dropping\s+", ". This dropped "),
    (r",\s+causing\s+", ". This caused "), (r",\s+reducing\s+", ". This reduced "), (r",\s+stabilizing\s+", ". This stabilized "),
    (r",\s+leading to\s+", ". This led to "), (r",\s+triggering\s+", ". This triggered "), (r",\s+resulting in\s+", ". This resulted in "),
    (r",\s+highlighting\s+", ". This highlights "), (r",\s+demonstrating\s+", ". This demonstrates "),
    (r",\s+indicating\s+", ". This indicates "), (r",\s+underscoring\s+", ". This underscores "),
    (r",\s+emphasizing\s+", ". This emphasizes "), (r",\s+confirming\s+", ". This confirms "), (r",\s+leaving\s+", ". This leaves "),
    (r",\s+while\s+", ". Meanwhile, "), (r",\s+whereas\s+", ". In contrast, "), (r",\s+yet\s+require\s+", ". Yet they require "),
    (r",\s+yet\s+", ". Yet "), (r",\s+which\s+reduced\s+", ". This reduced "), (r",\s+which\s+cut\s+", ". This cut "),
    (r",\s+which\s+increased\s+", ". This increased "), (r",\s+thereby\s+([a-z]+)ing\s+", ". This $1s "),
)
# Where a sentence of more than 16 words is split, once, the first that it has.
COMPOUNDS = (
    (r",\s+so\s+([a-z])", ". Consequently, $1"), (r",\s+and\s+the\s+([a-z])", ". The $1"), (r",\s+where\s+([a-z])", ". There, $1"),
    (r",\s+as\s+([a-z])", ". As $1"), (r",\s+but\s+([a-z])", ". Yet $1"),
)
# Fixed value: a list of three, of which the third is dropped, before a mark or one of these verbs.
TRIAD_OF = (
    r"\b([a-zA-Z0-9_\-\s]{2,45}?),\s+([a-zA-Z0-9_\-\s]{2,45}?),\s+(?:and|or)\s+([a-zA-Z0-9_\-\s]{2,45}?)\b"
    r"(?=[\.,;]|\s+(?:routinely|depend|remain|persist|do|can|function|are|were|have|had|will|to)\b)"
)
TRIAD_COUNT = r"\b[a-zA-Z0-9_\-\s]{2,40}?,\s+[a-zA-Z0-9_\-\s]{2,40}?,\s+(?:and|or)\s+[a-zA-Z0-9_\-\s]{2,40}?\b"
