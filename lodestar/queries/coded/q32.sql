SELECT c_city, s_city, d_year, sum(lo_revenue) AS revenue
FROM customer, lineorder, supplier, ddate
WHERE lo_custkey = c_custkey
  AND lo_suppkey = s_suppkey
  AND lo_orderdate = d_datekey
  AND c_nation = 24
  AND s_nation = 24
  AND d_year BETWEEN 1995 AND 2000
GROUP BY c_city, s_city, d_year
ORDER BY d_year, revenue DESC
