SELECT d_year, c_nation, count(*) AS cnt
FROM ddate, customer, supplier, part, lineorder
WHERE lo_custkey = c_custkey
  AND lo_suppkey = s_suppkey
  AND lo_partkey = p_partkey
  AND lo_orderdate = d_datekey
  AND c_region = 1
  AND s_region = 1
  AND p_mfgr IN (0, 1)
GROUP BY d_year, c_nation
ORDER BY d_year, c_nation
