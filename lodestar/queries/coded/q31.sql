SELECT c_nation, s_nation, d_year, sum(lo_revenue) AS revenue
FROM customer, lineorder, supplier, ddate
WHERE lo_custkey = c_custkey
  AND lo_suppkey = s_suppkey
  AND lo_orderdate = d_datekey
  AND c_region = 2
  AND s_region = 2
  AND d_year BETWEEN 1995 AND 2000
GROUP BY c_nation, s_nation, d_year
ORDER BY d_year, revenue DESC
