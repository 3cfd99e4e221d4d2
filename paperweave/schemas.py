"""Explicit schemas; nothing is inferred from data."""

AUTHOR = "struct<authorId:string,name:string,homepage:string,affiliations:array<string>,externalIds:struct<DBLP:string>>"
PAPER = (
    "struct<paperId:string,title:string,abstract:string,year:int,publicationDate:string,externalIds:struct<DBLP:string,DOI:string>,"
    f"authors:array<{AUTHOR}>,publicationTypes:array<string>,journal:struct<name:string>>"
)
#: The JSON body of each endpoint. An author's DBLP names are read as text, since a lone name may stand for a list.
ENDPOINTS = {
    "paper": PAPER,
    "references": f"struct<data:array<struct<citedPaper:{PAPER}>>>",
    "citations": f"struct<data:array<struct<citingPaper:{PAPER}>>>",
    "authors": f"struct<data:array<{AUTHOR}>>",
    "author_papers": "struct<data:array<struct<paperId:string,title:string>>>",
}
#: The key a usable body of each endpoint must have.
REQUIRED = {"paper": "paperId", "references": "data", "citations": "data", "authors": "data", "author_papers": "data"}

RAW_DOC = "raw_id bigint, endpoint string, key_id string, path string, n_bytes int, fetched_at timestamp, loaded_at timestamp, body string"
