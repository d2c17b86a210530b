"""Base forms of words, told by their endings."""

from learngraph.functions.lemmas import lemma

NOUNS = """pointers pointer arrays array classes class boxes box queries query libraries library keys key sizes size caches cache values value branches branch hashes hash indices index indexes index
vertices vertex matrices matrix analyses analysis hypotheses hypothesis viruses virus statuses status causes cause houses house cases case buses bus biases bias series series bus bus class class
heroes hero shoes shoe ties tie people person children child feet foot mice mouse criteria criterion halves half curves curve metrics metric statistics statistics graphs graph nodes node trees tree
axes axis data datum string string king king physics physics news news proofs proof"""
VERBS = """making make taking take using use used use parsing parse parsed parse reducing reduce traced trace solving solve solved solve merging merge managed manage changing change hanging hang
belonging belong arranged arrange running run mapping map mapped map stopped stop debugging debug planned plan formatting format adding add passing pass processed process calling call controlled control
cancelled cancel modelling model installed install recalled recall creating create calculated calculate iterating iterate treating treat repeated repeat floating float updating update editing edit
limited limit visiting visit writing write rewriting rewrite computing compute executed execute distributing distribute deleting delete completed complete targeted target noting note promoted promote
enabling enable handled handle sampling sample compiling compile profiled profile scaling scale modeling model labeled label failing fail scheduled schedule storing store restored restore exploring explore
comparing compare declared declare requiring require configured configure measured measure filtering filter ordered order monitoring monitor occurred occur repairing repair defining define combined combine
determined determine joining join trained train opened open listening listen positioned position tuning tune pruned prune returning return naming name renamed rename assumed assume performing perform
streaming stream programming program coding code encoded encode including include provided provide avoiding avoid loaded load reading read building build invoking invoke looking look worked work
typing type shaped shape developing develop escaped escape describing describe applied apply applying apply studied study died die dying die tied tie caching cache reaching reach searched search
focused focus biased bias agreed agree seeing see freed free written write wrote write took take chosen choose built build found find thought think known know held hold sizing size organized organize
valued value queued queue nested nest tested test sorted sort hashing hash closing close increased increase based base sensing sense licensed license wanted want"""
OTHERS = "faster fast largest large bigger big biggest big easier easy earliest early better good computer computer paper paper order order interest interest test test forest forest need need red red speed speed hundred hundred during during nothing nothing bring bring spring spring"


def test_base_forms():
    words = f"{NOUNS} {VERBS} {OTHERS}".split()
    pairs = list(zip(words[::2], words[1::2], strict=True))
    assert len(pairs) >= 200
    assert [(w, lemma(w), b) for w, b in pairs if lemma(w) != b] == []


def test_base_forms_stay():
    for word in sorted({w for w in f"{NOUNS} {VERBS}".split()[1::2]}):
        assert lemma(word) == word, word
