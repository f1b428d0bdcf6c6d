"""Small literal relations, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (schema, rows). Lists become arrays.
FIXTURES: dict[str, tuple[str, list[tuple]]] = {
    "catalog": (
        "ord int, number int, author string, title string, university string, status string, date string, industry string, url string, recording string",
        [
            (1, 1, "Ada Birch", "Sparse models, revisited", "North", "ongoing", "", "Acme", "", ""),
            (2, 2, "Ben Cole", "The \"quoted\" title", "North", "Completed", "Aug. 2024", "Acme", "https://example.org/2", ""),
            (3, 3, "Cy Dunn", "Graphs & 50% of trees", "North", "completed", "July 2025", "", "", "https://example.org/v3"),
            (4, 1, "Di Eck", "Waves_and_noise", "South", "completed", "2012", "Borealis", "", ""),
            (5, 2, "Ed Frost", "Maps", "South", "ongoing", "2025 spring", "borealis oy", "", "https://example.org/v5"),
            (6, 4, "Flo Gale", "Nets #1", "North", "completed", "May 2024", "Cirrus", "https://example.org/6", "https://example.org/v6"),
            (7, 5, "Gus Hart", "More nets", "north", "completed", "2024, June", "Borealis", "", ""),
        ],
    ),
    "topics": (
        "ord int, id int, title string, area string, status string, difficulty string, refs string, data_source string, description string, url string",
        [
            (1, 1, "Open data", "", "open", "easy", "", "web", "All of it.", "https://example.org/t1"), (2, 2, "Closed loops", "Control", "taken", "hard", "a 2020 | b 2021|c", "", "", ""), (3, 3, "Wide nets", "Learning", "open", "easy", " one ", "", "Wider.", ""),
            (4, 4, "Deep nets", "Learning", "Open", "hard", "x||y", "", "", ""),
        ],
    ),
    "lines": (
        "doc_id int, ord int, page int, text string",
        [
            (1, 1, 1, "Contents"), (1, 2, 1, "Introduction .......... 3"), (1, 3, 1, ""), (1, 4, 2, "1 Introduction"), (1, 5, 2, "We use the DBN model (see Fig. 2). A deep belief net (DBN) is e.g. a stack."), (1, 6, 2, "The DBN works well."), (1, 7, 2, " "),
            (1, 8, 3, "Figure 1: A long caption that"), (1, 9, 3, "wraps over two lines"), (1, 10, 3, ""), (1, 11, 3, "Table 2. Short"), (1, 12, 3, ""), (1, 13, 3, "A support vector machine (SVM) is very good. The LSTM and the LSTM are used."), (1, 14, 4, "A deep belief net (DBN) again, with CNN."),
            (1, 15, 4, ""), (1, 16, 5, "References"), (1, 17, 5, "[1] A. Birch, \"A title of note,\" 2020."), (1, 18, 5, "continued here"), (1, 19, 5, "[2] Someone, A title without quotes, 2021."), (2, 1, 1, "This is short."), (2, 2, 1, "RNN and RNN."), (2, 3, 1, "Bibliography"), (2, 4, 1, "GAN GAN GAN"),
        ],
    ),
    "tex": (
        "doc_id int, ord int, text string",
        [
            (1, 1, r"\section{One} \label{sec:one} % a comment \label{no}"), (1, 2, r"Half is 50\% of it, see \ref{eq:a,fig:x} and \eqref{eq:b}."), (1, 3, r"\begin{equation}\label{eq:a}"), (1, 4, r"a = b"), (1, 5, r"\end{equation}"), (1, 6, "where b is given."),
            (1, 7, r"\begin{align*}"), (1, 8, r"c &= d\\% tail"), (1, 9, r"\end{align*}"), (1, 10, r"\begin{figure}"), (1, 11, r"\caption{A figure}"), (1, 12, r"\end{figure}"), (1, 13, r"\begin{eqnarray} e \end{eqnarray}"), (1, 14, r"\begin{equation} f. \end{equation}"),
            (1, 15, r"\begin{table}\caption{T}\label{tab:t}"), (1, 16, r"\end{table}"), (1, 17, r"\label{eq:b} \hyperref[sec:one]{there}"), (1, 18, r"\bibliographystyle{unsrtnat} \citet{x} \citep{y}"), (2, 1, r"\ref{tab:t} \label{lem:z}"), (2, 2, r"\begin{figure} no caption"), (2, 3, r"\end{figure} \usepackage[style=ieee]{biblatex}"),
            (3, 1, r"\begin{figure}\caption{Outer}"), (3, 2, r"\begin{equation}\label{eq:in}"), (3, 3, r"\end{equation}\label{fig:out}"), (3, 4, r"\end{figure}\label{sec:after}"), (3, 5, r"see \ref{eq:in} \end{align}"), (3, 6, r"\begin{align} z \end{align}"),
        ],
    ),
    "formulas": (
        "doc_id int, ord int, text string",
        [
            (1, 1, r"\begin{equation}\label{eq:a}"), (1, 2, r"a = b \nonumber"), (1, 3, r"\end{equation}"), (1, 4, "Then it follows."), (1, 5, r"\[ c = d \]"), (1, 6, ""), (1, 7, "Here starts a sentence."), (1, 8, r"\begin{align} e &= f, \end{align}"), (1, 9, "Fine."),
            (1, 10, r"\begin{gather*}"), (1, 11, r"g % a comment."), (1, 12, r"\end{gather*} where"), (1, 13, r"where $x$ and $" + "y + " * 25 + r"z$ are"), (1, 14, r"\begin{figure}\caption[s]{A {nested \emph{short}} one}"), (1, 15, r"\end{figure}"),
            (1, 16, r"\begin{table*} none \end{table*}"), (1, 17, r"\begin{figure}"), (1, 18, r"\caption{This is a caption with quite enough words}"), (1, 19, r"\end{figure}"), (2, 1, "(Birch, 2020) (Cole and Dunn, 2019a) (Eck et al., 2018)"), (2, 2, "(Frost 2021)"), (2, 3, "References"), (2, 4, "(Gale, 2001)"),
        ],
    ),
    "layout": (
        "doc_id int, ord int, page int, y double, bottom double, x0 double, text string, bold boolean",
        [
            (1, 1, 1, 10.0, 20.0, 50.0, "1 Introduction", True), (1, 2, 1, 40.0, 50.0, 50.0, "The first line", False), (1, 3, 1, 52.0, 62.0, 50.0, "goes on (3) as in Eq. (4) and (4).", False), (1, 4, 1, 80.0, 90.0, 500.0, "(3)", False),
            (1, 5, 2, 5.0, 15.0, 50.0, "Figure 2: Caption", False), (1, 6, 2, 16.0, 26.0, 50.0, "2 Not bold", False), (1, 7, 3, 5.0, 15.0, 50.0, "(9)", False), (2, 1, 1, 0.0, 10.0, 10.0, "Alone", False),
        ],
    ),
    "terms_used": ("doc_id int, ord int, term string", [(1, 1, "Kernel"), (1, 2, " kernel "), (1, 3, "Widget"), (2, 1, "KERNEL"), (1, 4, "widget")]),
    "sentences": (
        "doc_id int, ord int, text string",
        [
            (1, 1, "This is significantly better."), (1, 2, "It improves significantly, by 5 units."), (1, 3, "A very large gain [3] was seen."), (1, 4, "The model converges smoothly."), (1, 5, "We will see later that it holds."), (1, 6, "As we will see, it does."), (1, 7, "More on this later."), (1, 8, "We shall discuss it."),
            (1, 9, "These show nothing."), (1, 10, "It was enormous; statistically significant with p < 0.1."), (2, 1, "Reported in a companion study."), (2, 2, "Reported in a companion paper [7]."), (2, 3, "The results are shown elsewhere."), (2, 4, "Those results are fine, as in Fig. 3."),
        ],
    ),
    "codes": (
        "doc_id int, ord int, text string",
        [(1, 1, "The requirements are R1 (Speed) and R3 and R4."), (1, 2, "R3 matters, and R4 and R4."), (1, 3, "T1, T2 and T3 were run; F1 and L2 are known."), (1, 4, "Q7 alone."), (1, 5, "Z30 and Z31 and Z32 are numbers of parts."), (2, 1, "H1: Growth. H2 stands for decline. The hypotheses H1 and H2 hold.")],
    ),
    "terms": (
        "doc_id int, ord int, text string",
        [(1, 1, "The data set and the dataset. Data  sets, datasets and resampled samples."), (1, 2, "One sample and two samples; a pre-sample is none."), (2, 1, "A neural net is a neural net. The step-size and step size."), (2, 2, "A cost function, cost functions, and k-means with k-means.")],
    ),
    "units": (
        "doc_id int, ord int, level int, title string",
        [(1, 1, 1, "One"), (1, 2, 2, "One a"), (1, 3, 3, "One a i"), (1, 4, 1, "Two"), (1, 5, 2, "Two a"), (1, 6, 2, "Two b"), (1, 7, 1, "Three"), (1, 8, 3, "Three deep"), (1, 9, 1, "Four"), (2, 1, 1, "A"), (2, 2, 2, "B"), (2, 3, 3, "C"), (2, 4, 3, "D")],
    ),
    "defs": ("doc_id int, kind string, num string, page int, y double", [(1, "figure", "1", 2, 100.0), (1, "figure", "2", 5, 40.0), (1, "table", "1", 3, 300.0), (1, "table", "05", 7, 10.0), (1, "equation", "3", 1, 50.0), (1, "figure", "2", 6, 1.0), (1, "figure", "9", 9, 9.0)]),
    "crefs": ("doc_id int, kind string, num string, page int, y double, ord int", [(1, "figure", "1", 3, 10.0, 1), (1, "figure", "2", 2, 40.0, 2), (1, "table", "1", 3, 100.0, 3), (1, "table", "5", 4, 10.0, 4), (1, "table", "7", 4, 10.0, 5), (1, "figure", "2", 2, 40.4, 6), (1, "table", "7", 5, 1.0, 7), (1, "equation", "3", 2, 1.0, 8)]),
    "paragraphs": (
        "doc_id int, ix int, text string, is_caption boolean, introduced array<string>, used array<string>",
        [(1, 0, "we use kernels and widgets", False, ["widget"], ["kernel"]), (1, 1, "a kernel is defined here", False, ["kernel"], ["kernel", "gizmo"]), (1, 2, "figure with gizmos", True, [], ["gizmo"]), (1, 3, "the gizmo comes last", False, ["gizmo"], ["widgets"]), (2, 0, "Gradient descents and kernel widgets; the loss", False, [], []), (2, 1, "gradient  descent is defined", False, ["gradient descent", "loss"], ["kernel"]), (2, 2, "a kernel-like thing", False, ["kernel"], [])],
    ),
    "mentions": ("doc_id int, ord int, text string", [(1, 1, "Tables 11-14"), (1, 2, "Figures 5 and 6"), (1, 3, "Figs. 13/16/19"), (1, 4, "Tables 2-90"), (1, 5, "Figure A1, 2.4 to 2.6")]),
    "bib": (
        "id string, title string, authors array<string>, venue string, year string, arxiv string, url string",
        [
            ("a", "Deep Learning of Things", ["Ada Birch", "Ben Cole"], "Journal of Nets", "2020", "", ""), ("b", "A Study of Trees", ["Cy Dunn"], "", "2019", "", ""), ("c", "Waves", ["Di Eck"], "arXiv", "2018", "1801.00001", ""),
            ("d", "Unknown Work", ["Ed Frost"], "Nowhere", "2015", "", ""), ("e", "Some Page", [], "", "", "", "https://example.org"), ("f", "Maps of the North", ["Flo Gale", "Gus Hart"], "Proc. of Maps", "2011", "", ""),
            ("g", "Quiet Fields", ["Hal Iris"], "", "2021", "2101.00002", ""), ("h", "Never Looked Up", ["Ivy Jay"], "Journal of Nets", "2020", "", ""), ("i", "Never Found", ["Jo Kay"], "Journal of Nets", "2020", "", ""),
            ("j", "A Lone Preprint", ["Kim Low"], "arXiv preprint", "2022", "2201.00003", ""), ("k", "Abbreviated Venues", ["Lee Moss"], "JoMN", "2020", "", ""), ("l", "Spelled Otherwise", ["Rita Hasselbacher"], "Journal of Nets", "2020", "", ""),
            ("m", "", [], "", "", "", ""), ("n", "A Set of Pictures", ["Mo Nash"], "Kaggle", "2020", "", ""),
        ],
    ),
    "candidates": (
        "bib_id string, ord int, source string, title string, authors array<string>, venue string, year string, type string, sim double",
        [
            ("a", 1, "crossref", "Deep learning of things", ["Birch", "Cole"], "Journal of Nets", "2020", "journal-article", 1.0), ("a", 2, "dblp", "Deep learning", ["Other"], "Other", "2010", "", 0.72), ("b", 1, "crossref", "The Study of a Tree", ["Dunn"], "Forests", "2019", "", 0.8),
            ("c", 1, "dblp", "Waves", ["Eck"], "Waves Letters", "2021", "", 1.0), ("d", 1, "crossref", "Nothing like it", ["Zed"], "X", "2000", "", 0.3), ("f", 1, "crossref", "Maps of the North", ["Quince"], "Annals of Rivers", "2014", "", 1.0),
            ("g", 1, "crossref", "Quiet Fields", ["Other"], "Fields", "1990", "", 1.0), ("g", 2, "arxiv", "Quiet Fields of Grass", ["Iris"], "arXiv", "2021", "preprint", 0.73), ("j", 1, "arxiv", "A Lone Preprint", ["Low"], "arXiv", "2022", "preprint", 1.0),
            ("k", 1, "dblp", "Abbreviated venues", ["Moss"], "Journal of Modern Nets", "2021", "", 1.0), ("l", 1, "dblp", "Spelled otherwise", ["R. Hasselbaecher"], "Journal of Nets", "2020", "", 1.0),
        ],
    ),
    "lookups": ("bib_id string, source string, failed boolean", [("h", "crossref", True), ("h", "dblp", True), ("i", "crossref", False), ("j", "s2", True), ("a", "dblp", True)]),
    "cited": ("doc_id int, title string", [(1, "Deep Learning of Things"), (1, "Waves and Fields"), (2, "Maps of the North")]),
    "found": ("doc_id int, title string", [(1, "deep learning of things"), (1, "Waves"), (1, "Maps of the North"), (2, "Waves"), (2, "MAPS"), (3, "Anything")]),
    "paged": ("doc_id int, text string", [(1, "one\ntwo\fthree"), (2, "alone"), (3, "\f\n"), (4, "")]),
    "cached": ("doc_id int, ix int", [(1, 0), (1, 1), (1, 3), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2)]),
    "numbered": (
        "doc_id int, ord int, page int, text string",
        [
            (1, 1, 1, "Figure 1: One"), (1, 2, 1, ""), (1, 3, 2, "Table 4. Four"), (1, 4, 2, ""), (1, 5, 3, "Figure 9: Nine"), (1, 6, 3, ""), (1, 7, 4, "see Figures 1-3 and Ta-"), (1, 8, 4, "ble 4, or Eq. (2), as in (5)"), (1, 9, 5, "a = b        (2)"), (1, 10, 5, "(3)"), (1, 11, 5, "c = d   (5)"), (1, 12, 6, "Figure 12 .......... 3"),
            (2, 1, 1, "Table 1: T"), (2, 2, 1, ""), (2, 3, 2, "Figure 9 is elsewhere, and Figure 3.1 shows"), (2, 4, 5, "Figure 9: Late"), (2, 5, 5, ""), (2, 6, 9, "Listing 2: Code"), (2, 7, 9, ""), (2, 8, 8, "Listing 2 below"),
        ],
    ),
    "judged": ("item string, ord int, raw string", [("1", 1, "{\"verdict\": \"PASS\", \"note\": \"fine\"}"), ("2", 2, "```json\n{\"verdict\": \"FAIL\", \"note\": \"no\"}\n```"), ("3", 3, "Well: {\"verdict\": \"PASS\", \"note\": \"ok\"} indeed"), ("4", 4, "garbage"), ("2", 5, "{\"verdict\": \"PASS\", \"note\": \"again\"}")]),
    "checklist": ("item string, question string", [("1", "One?"), ("2", "Two?"), ("3", "Three?"), ("4", "Four?"), ("5", "Five?")]),
    "inverted": ("id int, word string, positions array<int>", [(1, "the", [0, 3]), (1, "cat", [1]), (1, "saw", [2]), (1, "dog", [5]), (2, "alone", [0])]),
    "manifest_a": ("file string, sha string", [("a.py", "11"), ("b.py", "22"), ("c.py", "33")]),
    "manifest_b": ("file string, sha string", [("a.py", "11"), ("b.py", "99"), ("d.py", "44")]),
    "runs": ("script string, rc int, findings int", [("one", 0, 0), ("two", 1, 3), ("three", 2, 1), ("four", -9, 0), ("five", 0, 2)]),
    "registry": ("script string, grp string, pdf_ok boolean, tex_ok boolean, profiles array<string>", [("one", "Prose", True, True, ["thesis", "paper"]), ("two", "Math", False, True, ["thesis"]), ("three", "Prose", True, False, ["paper"]), ("four", "Structure", True, True, ["thesis"])]),
    "sections": ("doc_id int, location int, kind string, label string, text string", [(1, 0, "section", "a", r"see \ref{b} and \ref{c} and \ref{b}"), (1, 100, "subsection", "b", r"back to \ref{a}"), (1, 200, "section", "c", r"self \ref{c}"), (1, 300, "section", "d", "nothing"), (2, 0, "section", "e", r"to \ref{a} and \ref{e}")]),
    "caption_judged": ("caption string, method string, rule string, severity int, note string", [("F1", "pixels", "R1", 2, "low"), ("F1", "model", "R1", 2, "dim"), ("F1", "model", "R2", 1, "ok"), ("F2", "pixels", "R1", 0, "fine"), ("F2", "model", "R1", 3, "bad")]),
    "ai": (
        "doc_id int, ord int, text string",
        [
            (1, 1, "Use of AI tools"), (1, 2, "ChatGPT was used, version 4o."), (1, 3, "2 Results"), (2, 1, "Methods"), (2, 2, "We used Claude for editing."), (2, 3, "3 Results"), (3, 1, "Nothing of the kind."), (4, 1, "AI statement"), (4, 2, "No use of AI was made."), (5, 1, "AI declaration"), (5, 2, "Tools helped."), (6, 1, "Disclosure of AI"), (6, 2, "DeepL polished it."),
        ],
    ),
    "ai_tex": (
        "doc_id int, ord int, text string",
        [
            (1, 1, r"\chapter{Methods}"), (1, 2, "We measure."), (1, 3, r"\section{Use of AI}"), (1, 4, "ChatGPT 4.0 was used."), (1, 5, r"\chapter{Results}"), (2, 1, r"\chapter{Methodology}"), (2, 2, "AI tools were used for editing."), (2, 3, r"\chapter{Results}"), (3, 1, r"\chapter{Methods}"), (3, 2, "We measure."), (3, 3, r"\chapter{Thanks}"), (3, 4, "We used ChatGPT."),
        ],
    ),
    "answers_checklist": ("doc_id int, ord int, answer string", [(1, 1, '{"results": [{"id": "baselines", "verdict": "pass", "evidence": "p. 3"}, {"id": "limitations", "verdict": "FAIL", "evidence": " none ", "suggestion": "add"}, "junk"]}'), (1, 2, '```json\n{"results": [{"id": "limitations", "verdict": "PASS", "evidence": "p. 9"}]}\n```'), (2, 1, "no idea")]),
    "answers_split": ("doc_id int, ord int, answer string", [(1, 1, '{"methods": [{"name": "Net", "checks": [{"id": "train-set", "verdict": "PASS", "evidence": "p. 2"}, {"id": "test-set", "verdict": "fail", "evidence": "leak"}]}, {"checks": []}]}'), (2, 1, '{"methods": []}')]),
    "answers_questions": ("doc_id int, ord int, answer string", [(1, 1, '{"research_questions": [{"id": "RQ1", "verdict": "answered", "revisited": true}, {"id": "RQ2", "verdict": "ANSWERED"}, {"verdict": "PARTIALLY-ANSWERED"}]}'), (2, 1, "{}"), (3, 1, 'Well: {"research_questions": [{"id": "RQ1"}]} so')]),
    "answers_quality": ("doc_id int, ord int, answer string", [(1, 1, '{"questions": [{"id": "RQ1", "verdict": "STRONG"}, {"id": "RQ2", "verdict": "vague", "criteria_violated": ["scope", "clarity"]}], "scope": {"gap_identified": true, "aligned": true}}'), (2, 1, "{}")]),
    "works": ("doc_id int, title string", [(1, "Waves"), (1, "Trees"), (2, "Maps")]),
    "abstracts": ("title string, abstract string", [("Waves", "On waves."), ("Maps", "")]),
    "answers_related": ("doc_id int, ord int, answer string", [(1, 1, '{"assessments": [{"title": "Waves", "verdict": "faithful"}, {"title": "Trees", "verdict": "NOVELTY-OVERSTATED"}], "omissions": [{"title": "Maps of the North"}, {"title": "Waves"}, {"title": ""}]}'), (2, 1, '{"assessments": [{"title": "Maps", "verdict": "odd"}], "omissions": [{"title": "Waves"}]}')]),
    "intro_units": ("doc_id int, unit string", [(1, "1 Intro"), (1, "2 Methods"), (1, "3 Results")]),
    "answers_units": ("doc_id int, ord int, answer string", [(1, 1, '{"units": [{"id": "1 Intro", "verdict": "GOOD"}]}'), (1, 2, '{"units": [{"id": "2 Methods", "verdict": "missing"}, {"id": "3 Results", "verdict": "GOOD"}]}'), (1, 3, "?")]),
    "answers_openers": ("doc_id int, ord int, answer string", [(1, 1, '{"verdict": "OPAQUE", "problem": " who? "}'), (1, 2, '{"verdict": "STANDALONE"}'), (1, 3, "?"), (2, 1, '{"verdict": "opaque"}')]),
    "flow_ranges": ("doc_id int, ord int, first int, last int", [(1, 0, 0, 9), (1, 1, 9, 15)]),
    "answers_flow": ("doc_id int, ord int, answer string", [(1, 0, '{"breaks": [{"after": 3, "quote": "Then"}, {"after": 9, "quote": "late"}, {"after": "x"}, {"after": 3, "quote": "again"}]}'), (1, 1, '{"breaks": [{"after": 9, "quote": "On"}, {"after": 2, "quote": "early"}]}')]),
    "answers_prose": ("doc_id int, ord int, answer string", [(1, 1, '{"findings": [{"category": "jargon", "quote": "deep"}, {"category": "poetry", "quote": "x"}, {"category": " tense-drift ", "quote": "was"}]}'), (2, 1, '{"findings": "none"}')]),
    "weak_caps": ("doc_id int, ord int, label string", [(1, i, f"Figure {i}") for i in range(1, 18)]),
    "answers_captions": ("doc_id int, ord int, answer string", [(1, 0, '{"captions": [{"index": 2, "verdict": "WEAK", "violated": ["self-contained", "odd"]}, {"index": "3", "verdict": "weak"}, {"index": 4, "verdict": "GOOD"}, {"index": 99, "verdict": "WEAK"}]}'), (1, 1, '{"captions": [{"index": 1, "verdict": "WEAK", "violated": ["sentence-form", "states-what-shown"]}]}')]),
    "answers_types": ("doc_id int, ord int, answer string", [(1, 1, '{"findings": [{"code": "range", "claim": "p > 1"}, {"code": "BRIDGE-LOOSE", "claim": "a ~ b"}, {"code": "SMELL"}]}')]),
    "answers_claims": ("doc_id int, ord int, answer string", [(1, 1, '{"claims": [{"id": "C9", "claim": "fast", "support": "supported"}, {"claim": "new", "support": "maybe"}, {"claim": "small", "support": "PARTIAL"}]}')]),
    "figures": ("doc_id int, ord int, figure string, white double, dpi double", [(1, 1, "Figure 1", 0.7, 90.0), (1, 2, "Figure 2", 0.2, 300.0), (1, 3, "Figure 3", 0.99, None)]),
    "answers_figures": ("doc_id int, ord int, answer string", [(1, 1, '{"rules": {"R1": {"v": "ok"}, "R3": {"v": "weak", "note": "dim"}, "R8": {"v": "bad", "note": "junk"}, "R10": {"v": "odd"}}}'), (1, 2, '{"rules": {"R2": {"v": "NA"}, "R4": {"v": "bad", "note": "none"}}}'), (1, 3, '{"rules": {"R1": {"v": "ok"}}}')]),
    "samples": ("figure string, r int, g int, b int", [("F1", 255, 255, 255), ("F1", 246, 246, 246), ("F1", 245, 255, 255), ("F1", 0, 0, 0), ("F2", 1, 2, 3)]),
    "rasters": ("figure string, width int, points double", [("F1", 600, 144.0), ("F1", 300, 144.0), ("F2", 100, 6.0), ("F2", 500, 72.0)]),
    "usages": ("doc_id int, ord int, usage string", [(1, 1, '{"total_tokens": 120}'), (1, 2, "{}"), (1, 3, '{"total_tokens": 30}'), (2, 1, None)]),
    "prose_paras": ("doc_id int, ord int, text string", [(1, 1, "a" * 61), (1, 2, "short"), (1, 3, "b" * 70), (1, 4, "c" * 80), (2, 1, "d" * 60)]),
    "flow_paras": ("doc_id int, para int, text string", [(1, i, f"text {i}") for i in range(5)] + [(2, 0, "alone")]),
    "outline": (
        "doc_id int, ord int, level int, title string, body string",
        [(1, 1, 1, "Contents", "a" * 50), (1, 2, 1, "1 Start", "This is a first sentence of some length. Another one follows. And a third."), (1, 3, 2, "1.1 Detail", "Short."), (1, 4, 3, "1.1.1 Deep", "It goes on for more than forty characters here."), (1, 5, 1, "2 End", "The end is long enough to be judged as an opener.")],
    ),
    "unit_texts": ("doc_id int, text string", [(1, "Contents and so\n 1  Start here is the\nintro. 1.1 Detail more text. 1.2 Other text 2 End last.")]),
    "unit_titles": ("doc_id int, ord int, level int, title string", [(1, 1, 1, "1 Start"), (1, 2, 2, "1.1 Detail"), (1, 3, 2, "1.2 Other"), (1, 4, 1, "2 End"), (1, 5, 1, "9 Nowhere")]),
    "snapshot_paras": ("doc_id int, ix int, is_caption boolean, is_reference boolean", [(1, 0, False, False), (1, 1, True, False), (1, 2, False, False), (1, 3, False, False), (1, 4, False, True)]),
    "snapshot_results": ("doc_id int, ix int, introduced array<string>, forward_refs array<string>", [(1, 0, ["kernel"], ["widget"]), (1, 1, ["widget"], []), (1, 2, ["gizmo"], ["kernels", "widget", "gizmo"])]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = FIXTURES[name]
    return spark.createDataFrame(rows, schema)


def _literal(value: object) -> str:
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).upper() if isinstance(value, bool) else "NULL" if value is None else str(value)


def cte(*names: str) -> str:
    """The same relations as common table expressions, without WITH."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    out = []
    for name in names:
        schema, rows = FIXTURES[name]
        columns = [c.strip().split(" ", 1) for c in schema.split(", ")]
        cast = ", ".join(f"{c}::{kinds[k[6:-1]] + '[]' if k.startswith('array') else kinds[k]} AS {c}" for c, k in columns)
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        out.append(f"{name} AS (SELECT {cast} FROM (VALUES {values}) t({', '.join(c for c, _ in columns)}))")
    return ", ".join(out)
