"""Messages made from the star-schema tables, for queries and benchmarks: the tables hold no messages themselves.

``FACTS`` and ``ORDER_FACTS`` are plain SQL that Spark and DuckDB read alike: the values that the messages carry. The
encoders write them as wire text, and the oracles work from them without any message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rxweave import codes
from rxweave.functions.scalars import settled

#: A row for each line: (k, ln) aren't unique, so nothing is grouped by them.
FACTS = """
SELECT l_orderkey AS k, l_linenumber AS ln, l_returnflag AS flag, l_partkey AS pk, l_suppkey AS sk,
  substr('PCADQFRX', CAST(l_partkey % 8 AS INT) + 1, 1) AS an, CAST(l_suppkey % 4 AS INT) AS n_fb,
  CASE WHEN l_partkey % 5 = 0 THEN '1' WHEN l_partkey % 5 = 1 THEN '0' WHEN l_partkey % 5 = 2 THEN '2x' END AS fa,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) * 1000 AS milli, l_linenumber % 3 = 0 AS neg,
  CASE WHEN l_returnflag = 'A' THEN 'B1' WHEN l_returnflag = 'N' THEN 'B2' ELSE 'B3' END AS tx,
  CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS STRING) AS ship,
  CASE l_suppkey % 3 WHEN 0 THEN 'Testcase' WHEN 1 THEN 'Ann' ELSE 'X' END AS given, CASE l_linenumber % 2 WHEN 0 THEN 'Probe' ELSE 'Real' END AS family,
  CASE l_suppkey % 2 WHEN 0 THEN '7 Main Street' ELSE 'Box 9' END AS street, CASE l_linenumber % 3 WHEN 0 THEN '(212) 867-0001' WHEN 1 THEN '2125550001' ELSE '12345' END AS phone,
  CASE l_suppkey % 3 WHEN 0 THEN '123456' WHEN 1 THEN 'SYNTH123456' ELSE '12345' END AS patient,
  CAST(l_partkey % 3 AS INT) AS n_dur, CAST(l_partkey % 4 AS INT) AS n_ing, CAST((l_partkey + l_suppkey) % 3 AS INT) AS n_pay, l_suppkey % 3 = 0 AS bare
FROM lineitem
"""
#: The letters of a code by its number.
REASONS = "('DD', 'TD', 'ZZ')"
_MESSAGES = """
SELECT *,
  concat('610066D0', tx, rpad('PCN', 10, ' '), '1', '01', rpad(concat('P', sk), 15, ' '), ship, rpad('SW', 10, ' '), chr(30),
    concat_ws(chr(28), 'AM01', concat('C4', ship), CASE WHEN ln % 2 = 0 THEN 'C51' END, CASE WHEN pk % 9 = 0 THEN concat_ws(chr(28), concat('CA', given), concat('CBDr. Jo ', family), concat('CM', street), concat('CQ', phone), concat('CY', patient)) END), chr(30),
    concat_ws(chr(28), 'AM04', concat('C2SYNTH', k), CASE WHEN pk % 2 = 0 THEN concat('C1G', pk) END, CASE WHEN pk % 3 = 0 THEN 'C301' END), chr(30),
    concat_ws(chr(28), 'AM07', 'EM1', concat('D2', k, ln), CASE WHEN pk % 7 <> 0 THEN concat('D7', lpad(CAST(pk AS STRING), 11, '0')) END, CASE WHEN pk % 7 < 5 THEN '' || concat('E1', lpad(CAST(pk % 5 AS STRING), 2, '0')) END,
      concat('E7', milli), concat('D5', CASE WHEN sk % 2 = 0 THEN '30' ELSE '3x' END), 'D80', 'D30'), chr(30),
    concat_ws(chr(28), 'AM03', 'EZ01', concat('DB', 'N', sk)),
    CASE WHEN n_dur > 0 THEN concat(chr(30), concat_ws(chr(28), 'AM08', 'E4DD', 'E5M0', CASE WHEN n_dur > 1 THEN 'E4ZZ' END, CASE WHEN n_dur > 1 THEN '8E11' END)) ELSE '' END,
    CASE WHEN n_ing > 0 THEN concat(chr(30), concat_ws(chr(28), 'AM10', 'EF01', concat('EC', n_ing + ln % 2),
      concat_ws(chr(28), transform(sequence(1, n_ing), i -> concat_ws(chr(28), CASE WHEN NOT bare THEN 'RE03' END, concat('TE', pk, i), concat('ED', milli), concat('EE', cents)))))) ELSE '' END,
    CASE WHEN n_pay > 0 THEN concat(chr(30), concat_ws(chr(28), 'AM05', concat('4C', n_pay + ln % 2),
      concat_ws(chr(28), transform(sequence(1, n_pay), i -> concat_ws(chr(28), concat('5C0', i), '6C99', concat('7C', sk), 'HC07', concat('DV', cents), 'DV100', '6E06', CASE WHEN sk % 2 = 0 THEN concat('7E', cents) END, CASE WHEN ln % 3 = 0 THEN '7E50' END))))) ELSE '' END,
    CASE WHEN pk % 11 = 0 THEN concat(chr(30), concat_ws(chr(28), 'AM12', 'EU1', CASE WHEN sk % 2 = 0 THEN concat('EV', k) END)) ELSE '' END) AS request,
  concat('D0', tx, '1', 'A', '01', rpad(concat('P', sk), 15, ' '), chr(29),
    concat_ws(chr(28), 'AM21', concat('AN', an), concat('FA', fa), CASE WHEN sk % 2 = 0 THEN concat('F3', k) END, CASE WHEN n_fb > 0 THEN 'FB75' END, CASE WHEN n_fb > 1 THEN 'FBZZ' END, CASE WHEN n_fb > 2 THEN 'FBAG' END, CASE WHEN ln % 6 = 0 THEN 'FQsee note' END), chr(30),
    concat_ws(chr(28), 'AM23', concat('F5', CASE WHEN neg THEN concat(substr(CAST(cents AS STRING), 1, length(CAST(cents AS STRING)) - 1), substr('}JKLMNOPQR', CAST(cents % 10 AS INT) + 1, 1)) ELSE CAST(cents AS STRING) END),
      concat('F9', cents), CASE WHEN ln % 4 = 0 THEN 'F6bad' END, CASE WHEN ln % 4 = 1 THEN 'FM01' END, CASE WHEN ln % 4 = 2 THEN concat('F7+', cents) END),
    CASE WHEN n_dur > 0 THEN concat(chr(30), concat_ws(chr(28), 'AM24', concat_ws(chr(28), transform(sequence(1, n_dur), i -> concat_ws(chr(28), CASE WHEN (sk + i) % 2 = 0 THEN concat('J6', i) END,
      concat('E4', element_at(array('DD', 'TD', 'ZZ'), CAST((pk + i) % 3 AS INT) + 1)), concat('FYt', i)))), CASE WHEN ln % 2 = 0 THEN 'FYlast' END)) ELSE '' END,
    CASE WHEN n_pay > 0 THEN concat(chr(30), concat_ws(chr(28), 'AM28', concat('NT', n_pay + CASE WHEN ln % 5 = 0 THEN 1 ELSE 0 END), concat_ws(chr(28), transform(sequence(1, n_pay), i -> concat_ws(chr(28), concat('5C0', i), concat('7C', sk), 'MHPCN', concat('NU', k)))))) ELSE '' END) AS response
FROM facts
"""

ORDER_FACTS = """
SELECT o_orderkey AS k, o_custkey AS ck, CAST(o_orderkey % 14 AS INT) AS sort, CAST(o_custkey % 5 AS INT) AS v, CAST(o_orderkey % 6 AS INT) AS shape, o_orderpriority AS prio,
  CAST(round(o_totalprice) AS BIGINT) AS total, CAST(o_orderdate AS DATE) AS placed
FROM orders
"""
_SCRIPTS = """
SELECT *, concat('<?xml version="1.0"?>', '<m:Message xmlns:m="urn:x"', CASE v WHEN 0 THEN ' version="2017071"' WHEN 1 THEN ' version="2023011"' WHEN 2 THEN ' version="2099001"' WHEN 3 THEN '' ELSE ' Version="2017071"' END, '>',
  '<Header><To>PH', ck, '</To><From> DR ', k % 10, ' </From><MessageID>M', k, '</MessageID>', CASE WHEN sort >= 4 AND sort < 10 THEN concat('<RelatesToMessageID>M', k - 3, '</RelatesToMessageID>') ELSE '' END, CASE WHEN k % 3 = 0 THEN concat('<SentTime>2024-01-02T03:04:05Z</SentTime><PrescriberOrderNumber>O', k, '</PrescriberOrderNumber>') ELSE '<SentTime/>' END, '</Header>',
  '<Body>', body, '</Body></m:Message>') AS payload
FROM (SELECT *, CASE
  WHEN sort = 0 THEN concat('<m:NewRx>', parties, med, '</m:NewRx>')
  WHEN sort = 1 THEN concat('<RxRenewalRequest><RequestReferenceNumber>R', k, '</RequestReferenceNumber>', parties, med, '</RxRenewalRequest>')
  WHEN sort = 2 THEN concat('<RxChangeRequest>', parties, med, '</RxChangeRequest>')
  WHEN sort = 3 THEN concat('<CancelRx>', parties, '</CancelRx>')
  WHEN sort = 4 THEN concat('<RxRenewalResponse><RequestReferenceNumber>R', k - 3, '</RequestReferenceNumber><Response>', CASE shape WHEN 0 THEN '<Approved/>' WHEN 1 THEN '<Approved/><Denied><DenialReason>no</DenialReason></Denied>'
    WHEN 2 THEN concat('<ApprovedWithChanges>', med, '</ApprovedWithChanges>') WHEN 3 THEN '<Denied><ReasonCode>AA</ReasonCode></Denied>' WHEN 4 THEN '<Other/>' ELSE '<DenyNewToFollow/>' END, '</Response></RxRenewalResponse>')
  WHEN sort = 5 THEN concat('<RxChangeResponse>', CASE WHEN shape % 2 = 0 THEN '<Validated><Note>ok</Note></Validated>' ELSE '<Replace/>' END, '</RxChangeResponse>')
  WHEN sort = 6 THEN '<CancelRxResponse><Response><Denied><DenialReason>late</DenialReason></Denied></Response></CancelRxResponse>'
  WHEN sort = 7 THEN '<Status><Code>000</Code><Description>fine</Description></Status>'
  WHEN sort = 8 THEN '<Error><Code>600</Code><DescriptionCode>10</DescriptionCode></Error><Status><Code>000</Code></Status>'
  WHEN sort = 9 THEN '<Verify><Code> </Code></Verify>'
  WHEN sort = 10 THEN '<RxFill><Note>x</Note></RxFill>'
  WHEN sort = 11 THEN '<Unheard/>'
  WHEN sort = 12 THEN concat('<!-- note --><NewRx>', med, '</NewRx>')
  ELSE concat('<NewRx>', parties, med, '</NewRx><!-- ') END AS body
FROM (SELECT *,
  concat('<Patient><HumanPatient><Name><LastName>L', ck, '</LastName><FirstName>F</FirstName>', CASE WHEN ck % 3 = 0 THEN '<MiddleName>Q</MiddleName>' ELSE '' END, '</Name><Gender>', CASE WHEN ck % 2 = 0 THEN 'M' ELSE 'F' END, '</Gender><DateOfBirth>', CASE WHEN k % 2 = 0 THEN '<Date>1980-01-01</Date>' ELSE '1980-01-02' END,
    '</DateOfBirth></HumanPatient></Patient><Pharmacy><Identification><@>', 1000000 + ck, '</@></Identification><BusinessName>Store &amp; Co</BusinessName></Pharmacy><Prescriber><NonVeterinarian><Identification><NPI>', k, '</NPI>', CASE WHEN k % 2 = 0 THEN concat('<DEANumber>AB', k, '</DEANumber>') ELSE '' END, '</Identification><Name><LastName>Doc</LastName></Name></NonVeterinarian></Prescriber>') AS parties,
  concat('<MedicationPrescribed><DrugDescription>Drug ', k % 100, '</DrugDescription>', CASE WHEN shape = 0 THEN concat('<DrugCoded><ProductCode Qualifier="ND">', total, '</ProductCode></DrugCoded>')
    WHEN shape = 1 THEN '<DrugCoded><DrugDBCode><Code>77</Code><Qualifier>RxCUI</Qualifier></DrugDBCode></DrugCoded><Strength><StrengthValue>5</StrengthValue><StrengthForm><Code>C42</Code></StrengthForm><StrengthUnitOfMeasure>mg</StrengthUnitOfMeasure></Strength>' ELSE '' END,
    '<Quantity><Value>', total, CASE WHEN shape = 3 THEN '.5' WHEN shape = 4 THEN '.' ELSE '' END, '</Value></Quantity>', CASE WHEN k % 2 = 0 THEN '<DaysSupply>30</DaysSupply><Substitutions>0</Substitutions><WrittenDate><Date>2024-01-02</Date></WrittenDate><Note> take care </Note>' ELSE '<DaysSupply>3x</DaysSupply><WrittenDate>2024-01-03</WrittenDate>' END,
    CASE WHEN shape = 5 THEN '<Refills><Value>3</Value></Refills>' ELSE '<NumberOfRefills>1</NumberOfRefills>' END,
    CASE WHEN shape = 2 THEN '<Sig><SigText>take one</SigText><DoseDeliveryMethod>Take</DoseDeliveryMethod><DoseQuantity>1</DoseQuantity><DoseUnitOfMeasure Qualifier="NCI"><Code>C48542</Code></DoseUnitOfMeasure><Route>ORAL</Route><RouteOfAdministration><Code>PO</Code><CodeSystem>SNOMED</CodeSystem><Text>by mouth</Text></RouteOfAdministration><Site><Text>mouth</Text></Site><Frequency>daily</Frequency><Duration><Code>7</Code><Qualifier>none</Qualifier><Text>week</Text></Duration><Vehicle/><Indication>pain</Indication></Sig>'
      WHEN shape = 3 THEN '<Sig><SigText>take two</SigText><Dose> </Dose></Sig>' WHEN shape = 4 THEN '<Sig><SigText>as told</SigText></Sig>' WHEN shape = 5 THEN '<Directions>none</Directions><SigText>plain</SigText>' ELSE '<Directions>none</Directions>' END, '</MedicationPrescribed>') AS med
FROM facts))
""".replace("@>", codes.IDENTIFICATIONS["pharmacyNumber"] + ">")


def _read(spark: SparkSession, sf_dir: str, table: str, facts: str, messages: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # a small file: its rows go to all cores before the work on them starts
        rows = rows.repartition(cores)
    found = spark.sql(facts.replace(f"FROM {table}", "FROM {t}"), t=rows)
    return spark.sql(messages.replace("{", "{{").replace("}", "}}").replace("FROM facts", "FROM {f}"), f=found)


def claim_messages(spark: SparkSession, sf_dir: str, *sides: str) -> DataFrame:
    """The facts of every line and its messages: ``request``, ``response`` or (default) both."""
    made = _read(spark, sf_dir, "lineitem", FACTS, _MESSAGES)
    wanted = list(sides) or ["request", "response"]
    return settled(made.drop(*({"request", "response"} - set(wanted))), wanted)


def script_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of every order and its ``payload``."""
    return settled(_read(spark, sf_dir, "orders", ORDER_FACTS, _SCRIPTS).drop("parties", "med", "body"), ["payload"])
