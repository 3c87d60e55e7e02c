"""The 33 rules: id, name, severity and what each one reports. Ids, names and severities are fixed values."""

RULES = (
    ("CIT001", "undefined-citation", "error", "a cited key has no entry"),
    ("CIT002", "duplicate-key", "error", "an entry key is defined again"),
    ("CIT003", "unused-entry", "info", "nothing cites an entry"),
    ("CIT004", "near-duplicate", "warning", "two entries are the same work"),
    ("CIT005", "bibliography-missing", "error", "a bibliography is missing, unreadable or undeclared"),
    ("CIT006", "missing-required-fields", "info", "an entry lacks fields of its type"),
    ("CIT007", "bibtex-syntax-error", "error", "an entry cannot be parsed"),
    ("CIT008", "duplicate-field", "warning", "a field occurs twice in an entry"),
    ("TEX001", "missing-include", "warning", "an included file is missing"),
    ("TEX002", "include-cycle", "warning", "files include each other"),
    ("TEX003", "remote-bibliography", "info", "a bibliography is at a remote address"),
    ("TEX004", "unreadable-source", "warning", "a source file cannot be read"),
    ("CFG001", "unused-suppression", "info", "a suppression dropped nothing though its rule ran"),
    ("REF001", "identifier-conflict", "error", "an identifier belongs to another work"),
    ("REF002", "identifier-not-found", "error", "an identifier does not exist"),
    ("REF003", "not-found", "error", "no source that should have the work has it"),
    ("REF004", "retracted", "error", "the work was retracted"),
    ("REF005", "concern-or-correction", "warning", "there is an expression of concern or a correction"),
    ("REF010", "authors-disjoint", "error", "no author in common"),
    ("REF011", "authors-differ", "warning", "authors differ"),
    ("REF012", "title-differs", "warning", "the title differs"),
    ("REF013", "year-differs", "warning", "the year differs"),
    ("REF014", "venue-differs", "warning", "the venue differs"),
    ("REF015", "preprint-published", "warning", "a cited preprint was published"),
    ("REF016", "identifier-available", "info", "a DOI is known that the entry lacks"),
    ("REF017", "malformed-identifier", "warning", "an identifier is written incorrectly"),
    ("REF018", "arxiv-withdrawn", "warning", "the preprint was withdrawn"),
    ("REF019", "software-not-found", "info", "a linked repository or package does not exist"),
    ("REF020", "venue-unknown", "warning", "no catalogue knows the venue"),
    ("REF021", "link-gone", "info", "a linked page is gone and not archived"),
    ("REF090", "cannot-determine", "info", "no verdict, with reasons"),
    ("RUN001", "run-incomplete", "warning", "a source was unavailable"),
    ("RUN002", "checked-through-substitute", "info", "a substitute answered for a source"),
)
VERDICTS = ("verified", "metadata_mismatch", "identifier_conflict", "not_found", "cannot_determine")
