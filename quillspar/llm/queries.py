"""The queries of this subpackage and, where SQL can say it, their statements."""

from quillspar.llm import chat_format, mixing, prefix_trie, yinyang
from quillspar.llm.credentials import op5_credential_links
from quillspar.llm.cross_polytope import op2_cross_polytope
from quillspar.llm.decontamination import op4_decontamination
from quillspar.llm.html_paths import op1_html_extraction
from quillspar.llm.license_rules import op9_license_rules
from quillspar.llm.lsh_forest import op8_minhash_forest
from quillspar.llm.piece_bpe import op13_piece_bpe
from quillspar.llm.token_store import op6_token_store
from quillspar.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_cross_polytope": op2_cross_polytope,
    "op3_mixing": mixing.op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_credential_links": op5_credential_links,
    "op6_token_store": op6_token_store,
    "op7_chat_formatting": chat_format.op7_chat_formatting,
    "op8_minhash_forest": op8_minhash_forest,
    "op9_license_rules": op9_license_rules,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_yinyang_codes": yinyang.op12_yinyang_codes,
    "op13_piece_bpe": op13_piece_bpe,
}

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op7_chat_formatting": chat_format.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_yinyang_codes": yinyang.oracle(),
}
