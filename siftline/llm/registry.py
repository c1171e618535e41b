"""The queries of this package and their SQL."""

from .chat_format import OP13_SQL, op13_chat_format
from .decontaminate import op9_decontaminate
from .licences import op6_licences
from .minhash import OP2_SQL, op2_minhash
from .packing import op4_packing
from .pitman_yor import op7_pitman_yor
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_rules import OP8_SQL, op8_quality_rules
from .repeats import op1_repeats
from .sharding import op10_sharding
from .token_alignment import op12_token_alignment
from .token_counts import op3_token_counts
from .warc import OP5_SQL, op5_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_repeats, op2_minhash, op3_token_counts, op4_packing, op5_warc, op6_licences, op7_pitman_yor,
        op8_quality_rules, op9_decontaminate, op10_sharding, op11_prefix_trie, op12_token_alignment, op13_chat_format,
    )
}
ORACLE_SQL = {"op2_minhash": OP2_SQL, "op5_warc": OP5_SQL, "op8_quality_rules": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op13_chat_format": OP13_SQL}
