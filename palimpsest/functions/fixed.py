"""Word lists, limits and seeds that define observable results."""

#: Characters stripped from both ends of words and phrases.
PUNCTUATION = ".,;:!?\"'()[]{}"
#: Characters stripped from the right end of an object.
TRAILING = ".,;:!?"
#: White space as Python's str.split sees it; for Java's (?U).
WHITE = r"[\s\x1c-\x1f]"
#: Verbs that split a sentence, in order.
VERBS = ["is", "are", "was", "were", "has", "have", "had", "governs", "combines", "enables", "serves", "consists", "provides", "uses", "relies", "operates", "stores"]
#: Leading articles and pronouns.
ARTICLES = ["the", "a", "an", "this", "that", "it", "they", "we"]
#: Verbs of relations between entities, in order.
RELATION_VERBS = ["is", "are", "was", "were", "has", "have", "had", "contains", "includes", "refers", "uses", "defines", "implements", "extends", "produces", "creates", "transforms", "computes", "links", "maps", "connects"]
#: Words of a query that name nothing: of raw tokens; of cleaned tokens; of those that filter pages.
STOP_RAW = "what where when which about there their these those could would should does have been from with this that into than then also some only very most such each much many".split()
STOP_CLEAN = [*STOP_RAW, *"capital the is are was were being has had can may shall will must".split()]
STOP_FILTER = [
    *STOP_CLEAN,
    *"facts fact mentioned text information data content document page note include includes included described describes describe know told says said".split(),
    *"things thing something anything everything nothing list listed give tell find found search look check show showing relevant related important specific specifically".split(),
    *"details detail part parts section chapter story stories example examples case cases type types kind kinds sort sorts way ways time times place places name names".split(),
    *"number numbers word words sentence sentences paragraph paragraphs line lines point points item items element elements feature features aspect aspects".split(),
    *"topic topics subject subjects question questions answer answers problem problems solution solutions".split(),
]
#: Of the embedding: seeds of frequencies and phases, scale of the frequencies.
SEED_W, SEED_B, SCALE_W = 42, 43, 2.0
#: Terms of a page that are embedded, and their least length before stripping.
MAX_TERMS, LEAST_TERM = 50, 3
#: Of the diffusion: gain of the Laplacian, of activation, decay.
ALPHA, BETA, GAMMA = 0.1, 0.5, 0.01
#: Increments of strength when a triple is added: subject and object, predicate.
RHO_ENDS, RHO_PREDICATE = 0.1, 0.05
#: Tokens of a page; pages of a patch; patches of a signature.
PAGE_SIZE, FAN = 1000, 10
#: Bytes that stored entities, relations and facts count as.
ENTITY_BYTES, RELATION_BYTES, FACT_BYTES = 50, 40, 60
