"""Word lists and suffix tables the results depend on."""

# The English stop words used when posts are vectorised.
VECTOR_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

# The stop words used by the keyword and phrase dictionaries.
PHRASE_STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being
below between both but by can't cannot could couldn't did didn't do does doesn't doing don't down
during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her
here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's
its itself let's me more most mustn't my myself no nor not of off on once only or other ought our
ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than
that that's the their theirs them themselves then there there's these they they'd they'll they're
they've this those through to too under until up very was wasn't we we'd we'll we're we've were
weren't what what's when when's where where's which while who who's whom why why's with won't would
wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()

# The published stemming suffix tables (suffix -> replacement).
STEM_LONG_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ator": "ate", "ation": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEM_SHORT_SUFFIXES = {
    "icate": "ic", "alize": "al", "ative": "", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEM_FINAL_SUFFIXES = """
al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize
""".split()

# Default polarity lexicon; callers normally pass their own.
POSITIVE_WORDS = """
good great love like best nice happy awesome excellent amazing useful fast easy fun cool perfect
thanks win works beautiful
""".split()
NEGATIVE_WORDS = """
bad hate worst awful terrible sad broken slow crash crashes scam malware virus spam fake useless
annoying ugly fail fails
""".split()
