"""Each provider's routes, and addresses that come close to one."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import providers, url

U = "0a1b2c3d-1111-2222-3333-444455556666"
CASES = {
    "https://boards.greenhouse.io/Acme/jobs/12/?gh_jid=12": ("greenhouse", "acme", "12"),
    "https://job-boards.eu.greenhouse.io/acme/jobs/12": ("greenhouse", "acme", "12"),
    "https://boards.greenhouse.io/acme?gh_jid=12": ("greenhouse", "acme", "12"),
    "https://boards.greenhouse.io/acme?gh_jid=x12": None,
    f"https://jobs.eu.lever.co/Acme/{U.upper()}/apply": ("lever", "acme", U),
    "https://jobs.lever.co/acme/123": None,
    f"https://jobs.ashbyhq.com/Acme/{U}/application": ("ashby", "acme", U),
    f"https://www.shopify.com/careers/intern_{U}": ("ashby", "shopify", U),
    f"https://www.shopify.com/careers/intern_{U}?ashby_jid={U.upper()}": ("ashby", "shopify", U),
    f"https://www.shopify.com/careers/intern_{U}?ashby_jid=other": None,
    "https://lifeattiktok.com/search/71": ("bytedance", "bytedance", "71"),
    "https://lifeattiktok.com/referral/x/campus/position/72/detail": ("bytedance", "bytedance", "72"),
    "https://jobs.bytedance.com/en/position/73/detail": ("bytedance", "bytedance", "73"),
    "https://acme.wd1.myworkdayjobs.com/en-US/Careers/job/Remote/Intern_R-77": ("workday", "acme", "r-77"),
    "https://wd5.myworkdaysite.com/en-US/recruiting/acme/Site/job/X/Intern_R7": ("workday", "wd5.myworkdaysite.com/acme/site", "r7"),
    "https://wd5.myworkdaysite.com/acme/job/X/Intern_R7": ("workday", "wd5.myworkdaysite.com/acme", "r7"),
    "https://www.tesla.com/en_us/careers/search/job/intern-22": ("tesla", "tesla", "22"),
    "https://www.metacareers.com/jobs/5/": ("meta", "meta", "5"),
    "https://www.janestreet.com/join-jane-street/position/6/": ("janestreet", "janestreet", "6"),
    "https://higher.gs.com/roles/7": ("goldman-sachs", "goldman-sachs", "7"),
    "https://www.imc.com/us/careers/jobs/8": ("imc", "imc", "8"),
    "https://careers-acme.icims.com/jobs/9/intern/job?mode=job": ("icims", "careers-acme", "9"),
    "https://careers-acme.icims.com/jobs/9/intern": None,
    "https://careers.rivianvw.tech/rv/jobs/9/job": ("icims", "rv", "9"),
    "https://x.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/10": ("oracle", "x.fa.us2.oraclecloud.com/cx_1", "10"),
    "https://jobs.smartrecruiters.com/Acme/11-intern": ("smartrecruiters", "acme", "11"),
    "https://jobs.successfactors.com/job/Acme/Intern/12/": ("successfactors", "jobs.successfactors.com", "12"),
    "https://career4.successfactors.com/careers?company=AcmeP&career_ns=job_listing&career_job_req_id=13": ("successfactors", "acmep", "13"),
    "https://career4.successfactors.com/careers?company=AcmeP&career_job_req_id=13": None,
    "https://jobs.sapsf.com/career?career_ns=JOB_LISTING&company=a&career_job_req_id=14": ("successfactors", "a", "14"),
    "https://apply.workable.com/acme/j/0123ABCDEF/apply": ("workable", "acme", "0123abcdef"),
    "https://jobs.careers.microsoft.com/global/en/job/15": ("microsoft", "microsoft", "15"),
    "https://apply.careers.microsoft.com/careers/job/16": ("microsoft", "microsoft", "16"),
    f"https://ats.rippling.com/en-GB/acme/jobs/{U}": ("rippling", "acme", U),
    "https://acme.eightfold.ai/careers/job/17-x": ("eightfold", "acme.eightfold.ai", "17-x"),
    "https://recruiting.paylocity.com/Recruiting/Jobs/Details/18/acme": ("paylocity", "recruiting.paylocity.com", "18"),
    "https://jobs.jobvite.com/acme/job/oAb1": ("jobvite", "acme", "oab1"),
    "https://www.amazon.jobs/en/jobs/19/intern": ("amazon", "amazon", "19"),
    "https://www.google.com/about/careers/applications/jobs/results/20-intern": ("google", "google", "20"),
    "https://acme.taleo.net/careersection/EX/jobdetail.ftl?job=AB21&job=zz": ("taleo", "acme.taleo.net/ex", "ab21"),
    "https://acme.taleo.net/careersection/ex/jobdetail.ftl": None,
    "https://careers.united.com/us/en/job/WHQ22": ("united", "united", "whq22"),
    "https://careers.sig.com/jobs/23": ("sig", "sig", "23"),
    "https://jobs.intuit.com/job/x/intern/27595/24": ("intuit", "intuit", "24"),
    "https://jobs.apple.com/en-us/details/25-0836/intern": ("apple", "apple", "25"),
    "https://acme.bamboohr.com/careers/26": ("bamboohr", "acme", "26"),
    f"https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid={U}&jobId=27": ("adp", U, "27"),
    "https://db.recsolu.com/external/requisitions/AB_28": ("recsolu", "deutsche-bank", "ab_28"),
    "https://www.deshaw.com/careers/intern-29": ("deshaw", "deshaw", "29"),
    "https://www.deshaw.com/careers/30": ("deshaw", "deshaw", "30"),
    "https://acme.yello.co/jobs/Ab31": ("yello", "acme.yello.co", "ab31"),
    "https://acme.avature.net/en_US/jobs/JobDetail/32": ("avature", "acme.avature.net", "32"),
    "https://acme.avature.net/careers/JobDetail/33": ("avature", "acme.avature.net", "33"),
    "https://apply.deloitte.com/en_US/careers/JobDetail/x/34": ("avature", "deloitte", "34"),
    "https://jobs.ea.com/en_US/careers/JobDetail/x/35": ("avature", "electronic-arts", "35"),
    "https://careers.cisco.com/global/en/job/36": ("employer-career", "careers.cisco.com", "36"),
    "https://careers.point72.com/CSJobDetail?jobCode=CSS-37": ("employer-career", "point72", "css-37"),
    f"https://acme.pinpointhq.com/en/postings/{U}": ("pinpoint", "acme", U),
    "https://acme.applytojob.com/apply/Ab38/intern": ("applytojob", "acme", "ab38"),
    "https://acme.breezy.hr/p/0123456789ab-intern": ("breezy", "acme", "0123456789ab"),
    f"https://jobs.gusto.com/postings/acme-{U}": ("gusto", "gusto", U),
    "https://acme.hrmdirect.com/employment/job-opening.php?req=39": ("hrmdirect", "acme", "39"),
    "https://sjobs.brassring.com/TGnewUI/Search/Home/HomeWithPreLoad?partnerid=1&siteid=2&jobid=40": ("brassring", "1-2", "40"),
    "https://acme.hiringthing.com/job/41/intern": ("hiringthing", "acme", "41"),
    "https://hiringthing.com/job/41": None,
    "https://nothiringthing.com/job/41": None,
    "https://jobs.acme.com/open?gh_jid=42&ref=x": ("greenhouse", "acme", "42"),
    "https://jobs.acme.com/open?gh_jid=42&gh_jid=43": None,
    "https://acme.com/roles/44": ("greenhouse", "acme", "44"),
    "https://acme.com/roles/44?gh_jid=45": None,
    "https://both.com/r/46?gh_jid=46&id=46": ("greenhouse", "both", "46"),
    "https://both.com/r/46?gh_jid=46": None,
    "https://jobs.zz.below.example.net/5": ("near", "jobs.zz", "5"),
    "https://zz.example.net/5": ("far", "zz", "5"),
    "ftp://jobs.lever.co/acme/" + U: None,
    "not an address": None,
    None: None,
    "": None,
}
REVIEWED = (
    providers.presentation("jobs.acme.com", "acme", "/open", "query"), providers.presentation("acme.com", "acme", "/roles/(?<id>[0-9]+)", "path"), providers.presentation("both.com", "both", "/r/(?<id>[0-9]+)", "both", also="id"),
    ("far", ".example.net", "/(?<id>[0-9]+)", (), "${sub}"), ("near", ".below.example.net", "/(?<id>[0-9]+)", (), "${sub}"),
)


def test_every_provider(spark):
    rows = spark.createDataFrame([(a, k) for k, a in enumerate(CASES)], "url string, reference int")
    got = providers.with_references(rows, "url", (*REVIEWED, *providers.ROUTES), into="met").collect()
    wrong = [(r.url, CASES[r.url], r.met) for r in got if (r.met.provider, r.met.tenant, r.met.posting) != (CASES[r.url] or ("unknown", None, None))]
    assert not wrong and len(got) == len(CASES)
    assert {p for p, *_ in providers.ROUTES} <= {r.met.provider for r in got} and len({p for p, *_ in providers.ROUTES}) == 41


def test_empty_table_and_too_many_routes(spark):
    assert providers.with_references(spark.createDataFrame([], "url string")).count() == 0
    with pytest.raises(ValueError):
        providers.with_references(spark.createDataFrame([], "url string"), routes=[providers.ROUTES[0]] * (providers.MOST_ROUTES + 1))


@pytest.mark.parametrize(
    "address, form",
    [
        ("HTTPS://Jobs.Ashbyhq.com/Acme/Some-Role/application/?embed=1&b=2&a=1", "https://jobs.ashbyhq.com/acme/some-role?a=1&b=2"),
        ("https://www.boards.greenhouse.io/Acme/jobs/5/?gh_jid=6", "https://job-boards.greenhouse.io/acme/jobs/5?gh_jid=6"),
        ("https://boards.greenhouse.io/Acme/?gh_jid=6&gh_src=z#app", "https://job-boards.greenhouse.io/acme/jobs/6"),
        ("https://x.com:443/A/?b=2&b=1&a-b=0&a=9&utm_x=1&mc_eid=4", "https://x.com/A?a=9&a-b=0&b=2&b=1"),
        ("http://x.com:443/", "http://x.com:443"),
        ("mailto:a@b.c", None),
    ],
)
def test_canonical_forms(spark, address, form):
    assert spark.range(1).select(url.posting_canonical(F.lit(address))).first()[0] == form


def test_registrable_domains(spark):
    domains = {"a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "Jobs.Example.com.": "example.com", "10.1.2.3": "10.1.2.3", "localhost": "localhost", "::1": "::1", "x.y.com.sg": "y.com.sg", "": ""}
    got = spark.createDataFrame(list(domains.items()), "h string, d string").select("d", url.registrable(F.col("h")).alias("x")).collect()
    assert all(r.d == r.x for r in got)
    same = lambda a, b: spark.range(1).select(url.same_registrable(F.lit(a), F.lit(b))).first()[0]
    assert same("a.x.com", "x.com") and not same("good.co.uk", "evil.co.uk") and not same("localhost", "localhost") and not same(None, "x.com")
