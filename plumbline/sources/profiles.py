"""What is known of public flow datasets: roles, headerless column names, label groups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import q


@dataclass(frozen=True)
class Profile:
    id: str
    name: str
    roles: dict[str, str] = field(default_factory=dict)
    csv_columns: tuple[str, ...] = ()
    label_groups: dict[str, list[str]] = field(default_factory=dict)


# Published names of the datasets' columns and labels.
PROFILES = {
    p.id: p
    for p in (
        Profile("cic-ids-2017", "CIC-IDS2017", {"label": "Label", "dst_port": "Destination Port"}),
        Profile("cse-cic-ids-2018", "CSE-CIC-IDS2018", {"label": "Label", "dst_port": "Dst Port"}),
        Profile("unsw-nb15", "UNSW-NB15", {"label": "label"}),
        Profile(
            "unsw-nb15-raw",
            "UNSW-NB15, raw files without a header",
            {"label": "Label", "time": "Stime", "src_ip": "srcip", "dst_ip": "dstip", "src_port": "sport", "dst_port": "dsport", "protocol": "proto"},
            # fixed values: published column names, in order
            (
                "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes", "sttl",
                "dttl", "sloss", "dloss", "service", "Sload", "Dload", "Spkts", "Dpkts", "swin", "dwin",
                "stcpb", "dtcpb", "smeansz", "dmeansz", "trans_depth", "res_bdy_len", "Sjit", "Djit", "Stime",
                "Ltime", "Sintpkt", "Dintpkt", "tcprtt", "synack", "ackdat", "is_sm_ips_ports",
                "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "ct_srv_src", "ct_srv_dst",
                "ct_dst_ltm", "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
                "attack_cat", "Label",
            ),
        ),
        Profile(
            "ctu-13",
            "CTU-13",
            {"label": "Label", "time": "StartTime", "src_ip": "SrcAddr", "dst_ip": "DstAddr", "src_port": "Sport", "dst_port": "Dport", "protocol": "Proto"},
            (),
            {
                "botnet": ["flow=From-Botnet"],
                "to_botnet": ["flow=To-Botnet"],
                "normal": ["flow=From-Normal", "flow=To-Normal", "flow=Normal-"],
                "background": ["flow=Background", "flow=To-Background", "flow=From-Background"],
            },
        ),
        Profile(
            "ugr-16",
            "UGR'16",
            {"label": "label", "time": "te", "src_ip": "sa", "dst_ip": "da", "src_port": "sp", "dst_port": "dp", "protocol": "pr"},
            (
                "te", "td", "sa", "da", "sp", "dp", "pr", "flg", "fwd", "stos", "pkt", "byt", "label",
            ),
        ),
    )
}


class ProfileNotFound(KeyError):
    pass


def get_profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ProfileNotFound(f"unknown profile {name}; there are {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


def group_labels(df: DataFrame, label: str, groups: dict[str, list[str]]) -> DataFrame:
    """Each label replaced by its prefix's group (the first that fits; others stay), the original kept beside it."""
    out = None
    for group, prefixes in groups.items():
        for p in prefixes:
            test = q(label).startswith(p)
            out = F.when(test, group) if out is None else out.when(test, group)
    return df.withColumn("__label_original", q(label)).withColumn(label, q(label) if out is None else out.otherwise(q(label)))
