SELECT c_city, s_city, d_year, sum(lo_revenue) AS revenue
FROM customer, lineorder, supplier, ddate
WHERE lo_custkey = c_custkey
  AND lo_suppkey = s_suppkey
  AND lo_orderdate = d_datekey
  AND c_city IN (25, 65)
  AND s_city IN (25, 65)
  AND d_yearmonthnum = 200012
GROUP BY c_city, s_city, d_year
ORDER BY d_year, revenue DESC
