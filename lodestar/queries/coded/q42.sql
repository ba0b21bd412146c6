SELECT d_year, s_nation, p_category, sum(lo_revenue - lo_supplycost) AS profit
FROM ddate, customer, supplier, part, lineorder
WHERE lo_custkey = c_custkey
  AND lo_suppkey = s_suppkey
  AND lo_partkey = p_partkey
  AND lo_orderdate = d_datekey
  AND c_region = 1
  AND s_region = 1
  AND d_year IN (2000, 2001)
  AND p_mfgr IN (0, 1)
GROUP BY d_year, s_nation, p_category
ORDER BY d_year, s_nation, p_category
