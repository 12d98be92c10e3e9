"""Names, limits and policies that results depend on."""

# --- fixed values: enumerations -------------------------------------------------------------------
PROTOCOLS = ("TCP", "UDP", "ICMP", "OTHER")
PROTOCOL_NUMBERS = {"TCP": 6, "UDP": 17, "ICMP": 1, "OTHER": 0}
DIRECTIONS = ("A_TO_B", "B_TO_A")
FAMILIES = ("behaviour", "dns", "tls_quic")
SCHEMA_VERSIONS = {"behaviour": "behaviour.v1", "dns": "dns.v1", "tls_quic": "tls_quic.v1"}
THREAT_CLASSES = (
    "BENIGN", "DDOS", "C2", "BOT_OR_C2_LIKE", "RECON", "EXFILTRATION", "BENIGN_DNS", "DGA",
    "DNS_TUNNEL", "BENIGN_ENCRYPTED", "SUSPICIOUS_ENCRYPTED", "UNKNOWN",
)
BENIGN_CLASSES = ("BENIGN", "BENIGN_DNS", "BENIGN_ENCRYPTED")
DECISIONS = ("ACCEPT", "UNKNOWN_SUSPICIOUS", "INSUFFICIENT_EVIDENCE")
QUALITIES = ("STRONG", "ADEQUATE", "WEAK", "INSUFFICIENT")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
CAPABILITIES = (
    "has_packet_timestamps", "has_packet_sizes", "has_directionality", "has_tcp_flags",
    "has_dns_query_name", "has_dns_query_type", "has_tls_metadata", "has_tls_fingerprint",
    "has_quic_metadata", "has_bidirectional_stats",
)
TCP_FLAGS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128}

# --- fixed values: limits -------------------------------------------------------------------------
SECOND_US = 1_000_000
IDLE_US = 60 * SECOND_US
ACTIVE_US = 120 * SECOND_US
SNAPSHOT_US = SECOND_US
SNAPSHOT_MIN_PACKETS = 2
WINDOWS_S = (10, 60, 300)
MAX_WINDOW_EVENTS = 200_000
ID_BUCKET_S = 60
ALERT_COOLDOWN_US = 60 * SECOND_US
UNKNOWN_MIN_CONFIDENCE = 0.50
LATENCY_SAMPLES = 2000
RATE_INTERVAL_MS = 250
RATE_SAMPLES = 720
LATEST_ALERTS = 1000
BIGRAM_BUCKETS = 8
FINGERPRINT_BUCKETS = 256
PROVENANCE_BLOCK_ROWS = 512
MINIMUM_PRECISION = 0.80

# --- fixed values: model inputs and labels --------------------------------------------------------
FLOW_MODEL_FEATURES = (
    "flow_duration_seconds", "packets_outbound", "packets_inbound", "packet_count",
    "payload_bytes_outbound", "payload_bytes_inbound", "payload_bytes_total",
    "payload_packet_size_mean", "payload_packet_size_variance",
    "inter_arrival_mean", "inter_arrival_variance", "payload_directional_ratio",
    "flow_packets_per_second", "flow_payload_bytes_per_second",
)
LABEL_CLASSES = {"BENIGN": "BENIGN", "DDoS": "DDOS", "PortScan": "RECON", "Bot": "BOT_OR_C2_LIKE"}
MODEL_CLASSES = ("BENIGN", "DDOS", "RECON", "BOT_OR_C2_LIKE")
FLOW_CSV_FILES = (
    "Friday-WorkingHours-Morning.pcap_ISCX.csv",
    "Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv",
    "Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv",
)
FLOW_CSV_COLUMNS = (
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Std", "Bwd Packet Length Std", "Flow IAT Std",
)
FLOW_CSV_CORE = FLOW_CSV_COLUMNS[:5]
SPLIT_ROLES = ("train", "validation", "calibration", "test")

# --- fixed values: evidence required per class ----------------------------------------------------
EVIDENCE_POLICY = {
    "DDOS": {
        "required_capabilities": ["has_packet_timestamps", "has_directionality"],
        "required_evidence": ["target_packets_per_second", "unique_sources_for_destination",
                              "source_entropy_for_destination", "target_concentration"],
        "minimum_evidence": {"target_window_packets": 10, "history_seconds": 1, "unique_sources_for_destination": 2},
        "required_true": ["history_complete"],
    },
    "BOT_OR_C2_LIKE": {
        "required_capabilities": ["has_packet_timestamps", "has_directionality"],
        "required_evidence": ["connection_count", "periodicity_score", "destination_recurrence",
                              "mean_connection_interval"],
        "minimum_evidence": {"connection_count": 3, "history_seconds": 10},
        "required_true": ["history_complete"],
    },
    "C2": {
        "required_capabilities": ["has_packet_timestamps", "has_directionality"],
        "required_evidence": ["connection_count", "periodicity_score", "destination_recurrence"],
    },
    "RECON": {
        "required_capabilities": ["has_packet_timestamps"],
        "required_evidence": ["unique_destinations", "unique_destination_ports", "short_flow_ratio"],
        "minimum_evidence": {"source_window_packets": 3, "history_seconds": 1, "source_window_flow_count": 3},
        "required_true": ["history_complete"],
    },
    "EXFILTRATION": {
        "required_capabilities": ["has_directionality"],
        "required_evidence": ["outbound_inbound_ratio_window", "outbound_volume_window"],
    },
    "DGA": {
        "required_capabilities": ["has_dns_query_name"],
        "required_evidence": ["domain_length", "character_entropy"],
    },
    "DNS_TUNNEL": {
        "required_capabilities": ["has_dns_query_name"],
        "required_evidence": ["domain_length", "character_entropy", "query_frequency"],
    },
    "SUSPICIOUS_ENCRYPTED": {
        "any_capabilities": ["has_tls_metadata", "has_quic_metadata"],
        "required_evidence": ["packet_count", "packet_size_mean"],
    },
}
SEVERITY_RULES = {
    "DDOS": "HIGH", "C2": "HIGH", "BOT_OR_C2_LIKE": "HIGH", "RECON": "MEDIUM", "EXFILTRATION": "HIGH",
    "DGA": "MEDIUM", "DNS_TUNNEL": "HIGH", "SUSPICIOUS_ENCRYPTED": "MEDIUM", "UNKNOWN": "LOW",
}
