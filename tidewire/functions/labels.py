"""Code tables, as constants and as a DataFrame to join with."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The names of protocol codes, as their standards and the output contract have them.
NGAP_PDU = {0: "initiatingMessage", 1: "successfulOutcome", 2: "unsuccessfulOutcome"}
NGAP_PROCEDURE = {
    0: "AMFConfigurationUpdate",
    1: "AMFStatusIndication",
    2: "CellTrafficTrace",
    3: "DeactivateTrace",
    4: "DownlinkNASTransport",
    5: "DownlinkNonUEAssociatedNRPPaTransport",
    6: "DownlinkRANConfigurationTransfer",
    7: "DownlinkRANStatusTransfer",
    8: "DownlinkUEAssociatedNRPPaTransport",
    9: "ErrorIndication",
    10: "HandoverCancel",
    11: "HandoverNotification",
    12: "HandoverPreparation",
    13: "HandoverResourceAllocation",
    14: "InitialContextSetup",
    15: "InitialUEMessage",
    16: "LocationReportingControl",
    17: "LocationReportingFailureIndication",
    18: "LocationReport",
    19: "NASNonDeliveryIndication",
    20: "NGReset",
    21: "NGSetup",
    22: "OverloadStart",
    23: "OverloadStop",
    24: "Paging",
    25: "PathSwitchRequest",
    26: "PDUSessionResourceModify",
    27: "PDUSessionResourceModifyIndication",
    28: "PDUSessionResourceRelease",
    29: "PDUSessionResourceSetup",
    30: "PDUSessionResourceNotify",
    31: "PrivateMessage",
    32: "PWSCancel",
    33: "PWSFailureIndication",
    34: "PWSRestartIndication",
    35: "RANConfigurationUpdate",
    36: "RerouteNASRequest",
    37: "RRCInactiveTransitionReport",
    38: "TraceFailureIndication",
    39: "TraceStart",
    40: "UEContextModification",
    41: "UEContextRelease",
    42: "UEContextReleaseRequest",
    43: "UERadioCapabilityCheck",
    44: "UERadioCapabilityInfoIndication",
    45: "UETNLABindingRelease",
    46: "UplinkNASTransport",
    47: "UplinkNonUEAssociatedNRPPaTransport",
    48: "UplinkRANConfigurationTransfer",
    49: "UplinkRANStatusTransfer",
    50: "UplinkUEAssociatedNRPPaTransport",
    51: "WriteReplaceWarning",
    52: "SecondaryRATDataUsageReport",
}
NAS_DISCRIMINATOR = {0x2E: "5GS session management", 0x7E: "5GS mobility management"}
NAS_MM = {
    0x41: "Registration request",
    0x42: "Registration accept",
    0x43: "Registration complete",
    0x44: "Registration reject",
    0x45: "Deregistration request (UE originating)",
    0x46: "Deregistration accept (UE originating)",
    0x47: "Deregistration request (UE terminated)",
    0x48: "Deregistration accept (UE terminated)",
    0x54: "Service request",
    0x55: "Service reject",
    0x56: "Service accept",
    0x5C: "Configuration update command",
    0x5D: "Configuration update complete",
    0x5E: "Authentication request",
    0x5F: "Authentication response",
    0x60: "Authentication reject",
    0x61: "Authentication failure",
    0x62: "Authentication result",
    0x64: "Identity request",
    0x65: "Identity response",
    0x66: "Security mode command",
    0x67: "Security mode complete",
    0x68: "Security mode reject",
    0x6A: "5GMM status",
    0x6B: "Notification",
    0x6C: "Notification response",
    0x6D: "UL NAS transport",
    0x6E: "DL NAS transport",
}
NAS_SM = {
    0xC1: "PDU session establishment request",
    0xC2: "PDU session establishment accept",
    0xC3: "PDU session establishment reject",
    0xC5: "PDU session authentication command",
    0xC6: "PDU session authentication complete",
    0xC7: "PDU session authentication result",
    0xC9: "PDU session modification request",
    0xCA: "PDU session modification reject",
    0xCB: "PDU session modification command",
    0xCC: "PDU session modification complete",
    0xCD: "PDU session modification command reject",
    0xD1: "PDU session release request",
    0xD2: "PDU session release reject",
    0xD3: "PDU session release command",
    0xD4: "PDU session release complete",
    0xD6: "5GSM status",
}
IGMP_TYPE = {0x11: "Membership Query", 0x12: "IGMPv1 Membership Report", 0x16: "IGMPv2 Membership Report", 0x17: "Leave Group", 0x22: "IGMPv3 Membership Report"}
IGMP_VERSION = {0x12: "IGMPv1", 0x16: "IGMPv2", 0x17: "IGMPv2", 0x22: "IGMPv3"}
LLDP_TLV = {0: "End Of LLDPDU", 1: "Chassis ID", 2: "Port ID", 3: "Time To Live", 4: "Port Description", 5: "System Name", 6: "System Description", 7: "System Capabilities", 8: "Management Address", 127: "Organizationally Specific"}
STUN_CLASS = {0: "Request", 1: "Indication", 2: "Success Response", 3: "Error Response"}
STUN_METHOD = {1: "Binding"}
RTP_PAYLOAD = {0: "PCMU", 3: "GSM", 4: "G723", 8: "PCMA", 9: "G722", 18: "G729", 26: "JPEG", 31: "H261", 32: "MPV", 33: "MP2T", 34: "H263"}


#: The tables by the names that the statistics use.
TABLES: dict[str, dict[int, str]] = {
    "ngap_pdu": NGAP_PDU,
    "ngap_procedure": NGAP_PROCEDURE,
    "nas_discriminator": NAS_DISCRIMINATOR,
    "nas_mm": NAS_MM,
    "nas_sm": NAS_SM,
    "igmp_type": IGMP_TYPE,
    "igmp_version": IGMP_VERSION,
    "lldp_tlv": LLDP_TLV,
    "stun_class": STUN_CLASS,
    "stun_method": STUN_METHOD,
    "rtp_payload": RTP_PAYLOAD,
}


def constant(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A small table that is part of the plan."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, t.type) for c, t in zip(columns, to_arrow_schema(schema))], names=schema.names), schema)


def code_rows(spark: SparkSession) -> DataFrame:
    """``table, code, label``."""
    return constant(spark, [(name, code, label) for name, codes in TABLES.items() for code, label in codes.items()], "table string, code long, label string")


def rtp_other(code: Column) -> Column:
    """The name of a payload type that the table lacks."""
    text = code.cast("string")
    return F.when(code.between(96, 127), F.concat(F.lit("Dynamic("), text, F.lit(")"))).otherwise(F.concat(F.lit("PT("), text, F.lit(")")))
